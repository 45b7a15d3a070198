"""Writers.  Spark writes directories; each call is one job per output."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.operators.mining import context_rows, identifier_rows, in_review_order
from veilspark.sources.routing import FILE_TYPES


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_candidates(rows: DataFrame, base: str) -> None:
    """Three outputs in review order: all, context candidates, identifier candidates.

    The rows are sorted once: a filter leaves them in order, so each output is the kept ranges with fewer rows."""
    kept = in_review_order(rows).persist(StorageLevel.DISK_ONLY)
    try:
        for name, part in (("all", kept), ("ai", context_rows(kept)), ("regex", identifier_rows(kept))):
            write_csv(part.drop("unit_no"), f"{base}_{name}")
    finally:
        kept.unpersist()


def write_retrain_set(rows: DataFrame, path: str) -> None:
    """JSON lines."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_evaluation(path: str, **tables: DataFrame) -> None:
    """Named evaluation tables (summary, confusion, grade_report, misclassified, ...)."""
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}")


def _camel(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join(p.capitalize() for p in tail)


def _value(c: Column) -> Column:
    """Any value as JSON, null as ``null``."""
    listed = F.to_json(F.array(c), {"ignoreNullFields": "true"})
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _object(fields: dict[str, Column]) -> Column:
    """A JSON object of JSON values: every key is there, also where its value is null."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]), F.lit("}"))


def _item(df: DataFrame, names: list[str]) -> Column:
    """A location lists the parts it has; all other keys are always there."""
    return _object({
        "locationMeta" if n == "loc" else _camel(n):
            F.lit("null") if n not in df.columns else F.coalesce(F.to_json(n), F.lit("{}")) if n == "loc" else _value(F.col(n))
        for n in names})


ITEM = ["location_label", "loc", "label", "action", "original_text", "applied_text", "status",
        "applied_target_count", "skipped_target_count", "warnings", "grade", "source"]
REVIEW_ITEM = ["location_label", "loc", "label", "action", "context", "reason", "grade", "sensitive_type",
               "sensitive_category", "source"]
SUMMARY = ["total_locations", "applied_locations", "partial_locations", "skipped_locations", "total_warnings",
           "auto_target_count", "review_target_count"]


def result_documents(
    documents: DataFrame, items: DataFrame, reviews: DataFrame, summary: DataFrame, warnings: DataFrame | None = None,
    path: str = "path", size: str | None = None, output: str | None = None,
) -> DataFrame:
    """One JSON result per document (doc_id, result): file type, mode, items, reviews, warnings and
    summary, in a success envelope with the file's metadata.

    Every key is written, null where there is no value; a document without a summary row has all numbers 0.  Items are in
    order of ``unit_no`` where there is one, then of their location.  ``output`` names the column of written files.
    A document's result lists its own items, so its size follows the document."""
    def listed(df: DataFrame, names: list[str], alias: str) -> DataFrame:
        order = [F.col(c) for c in ("unit_no", "loc", "location_label") if c in df.columns]
        own = F.array_sort(F.collect_list(F.struct(*order, _item(df, names).alias("item"))))
        return df.groupBy("doc_id").agg(own.alias("_own")).select(
            "doc_id", F.concat(F.lit("["), F.array_join(F.transform("_own", lambda x: x["item"]), ","), F.lit("]")).alias(alias))

    numbers = summary.select("doc_id", *[F.col(c) if c in summary.columns else F.lit(0).alias(c) for c in SUMMARY])
    out = documents.join(listed(items, ITEM, "_auto"), "doc_id", "left") \
        .join(listed(reviews, REVIEW_ITEM, "_reviews"), "doc_id", "left").join(numbers, "doc_id", "left")
    if warnings is not None:
        out = out.join(warnings.groupBy("doc_id").agg(F.array_sort(F.collect_list("warning")).alias("_warnings")), "doc_id", "left")
    else:
        out = out.withColumn("_warnings", F.array().cast("array<string>"))
    kind = F.col("file_type")
    mode = F.lit(None).cast("string")
    for k, m in FILE_TYPES.items():
        mode = F.when(kind == k, m).otherwise(mode)
    none, empty = F.lit(None).cast("string"), F.lit("[]")
    return out.select("doc_id", _object({
        "success": F.lit("true"), "fileType": _value(kind), "applyMode": _value(mode), "inputFilePath": _value(F.col(path)),
        "outputFilePath": _value(F.col(output) if output else none),
        "autoResults": F.coalesce("_auto", empty), "reviewTargets": F.coalesce("_reviews", empty),
        "warnings": _value(F.coalesce("_warnings", F.array().cast("array<string>"))),
        "summary": _object({_camel(c): _value(F.coalesce(F.col(c), F.lit(0))) for c in SUMMARY}),
        "metadata": _object({"originalFilename": _value(F.regexp_extract(path, r"([^/]+)$", 1)),
                             "fileSize": _value(F.col(size) if size else F.lit(None).cast("bigint"))}),
    }).alias("result"))
