"""Which file goes where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File types by extension and how their results are delivered.
FILE_TYPES = {"xlsx": "applied", "csv": "applied", "docx": "guide", "pptx": "guide", "hwpx": "guide", "pdf": "guide"}


def file_type(path: Column) -> Column:
    """Type by extension; null when it is not supported."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin(*FILE_TYPES), ext)


def apply_mode(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, mode in FILE_TYPES.items():
        out = F.when(kind == k, mode).otherwise(out)
    return out


def route_files(files: DataFrame, path: str = "path") -> DataFrame:
    """Add file_type, apply_mode and, for unsupported files, error."""
    kind = file_type(F.col(path))
    return files.withColumns({
        "file_type": kind, "apply_mode": apply_mode(kind),
        "error": F.when(kind.isNull(), "UNSUPPORTED_FILE_TYPE"),
    })


def split_supported(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(supported, rejects)."""
    routed = route_files(files, path)
    return routed.where("error is null").drop("error"), routed.where("error is not null")
