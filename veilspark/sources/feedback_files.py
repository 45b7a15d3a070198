"""Feedback day files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.feedback import FEEDBACK
from veilspark.sources.tables import plain_path


def read_feedback(
    spark: SparkSession, path: str, date_from: str | None = None, date_to: str | None = None
) -> DataFrame:
    """Feedback of ``feedback_YYYY-MM-DD.json`` files (JSON arrays), days inclusive.

    Broken files are left out.  The day comes from the file name; the filter on it prunes nothing
    below a plain directory, so long ranges are better read from the partitioned store."""
    df = (
        spark.read.schema(FEEDBACK + ", _corrupt_record string").option("multiLine", True)
        .option("mode", "PERMISSIVE").option("pathGlobFilter", "feedback_*.json").json(path)
        .withColumn("feedback_date", F.regexp_extract(plain_path(F.col("_metadata.file_name")), r"^feedback_(.*)\.json$", 1))
        .withColumn("arrival", F.monotonically_increasing_id())
    )
    if date_from:
        df = df.where(F.col("feedback_date") >= date_from)
    if date_to:
        df = df.where(F.col("feedback_date") <= date_to)
    # A broken file arrives as one row without any field; a row with one odd field keeps the others.
    return df.where(F.col("_corrupt_record").isNull() | F.col("userGrade").isNotNull()).drop("_corrupt_record")


def read_feedback_store(spark: SparkSession, path: str) -> DataFrame:
    """Feedback appended by the stream, partitioned by ``feedback_date`` (pruned by date filters)."""
    return spark.read.schema(FEEDBACK + ", feedback_date string").json(path)
