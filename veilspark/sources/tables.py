"""Reading tables of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


PART = 1 << 20
MOST_PARTS = 64


def plain_path(c: Column) -> Column:
    """File metadata comes percent-encoded; a plus sign stands for itself there."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def spread(df: DataFrame, key: str, files: DataFrame | None = None) -> DataFrame:
    """Distribute a table by ``key`` when it comes in fewer files than there are cores.

    Text work is bound by CPU, and a few files (one row group each) would keep most cores idle.  A
    table of many files is left alone: its texts are then worked on where they are read.  For a stream ``files`` is
    the table it starts with.  Beyond ``PART`` bytes of files for each core there are more parts than cores, so that a task
    doesn't grow with the table (up to ``MOST_PARTS`` for each core)."""
    cores, files = df.sparkSession.sparkContext.defaultParallelism, df if files is None else files
    if len(files.inputFiles()) >= cores:
        return df
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores * min(MOST_PARTS, max(1, -(-size // (PART * cores)))), key)
