"""Feedback as a stream: append to the partitioned store, counts per day, detection on arriving units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.functions.rules import IDENTIFIER_RULES, Rule
from veilspark.operators.deid_plan import plan_units
from veilspark.operators.detection import detect_units
from veilspark.operators.feedback import split_payloads, valid_payload, with_flags
from veilspark.operators.redaction import redact_units

PAYLOAD = (
    "locationLabel string, context string, aiGrade string, userGrade string, fileType string, "
    "sensitiveCategory string, reason string, userId string, timestamp double"
)


#: Arriving lines that are no such object come whole in this column.
CORRUPT = "_corrupt_record"


def payload_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Arriving payload files (JSON lines), as they come."""
    return spark.readStream.schema(f"{PAYLOAD}, {CORRUPT} string").option("maxFilesPerTrigger", max_files).option(
        "columnNameOfCorruptRecord", CORRUPT).json(path)


def feedback_inbox(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Arriving payload files (JSON lines), accepted payloads only, with flags and day."""
    raw = spark.readStream.schema(PAYLOAD).option("maxFilesPerTrigger", max_files).json(path)
    return prepared(raw)


def prepared(payloads: DataFrame) -> DataFrame:
    at = F.timestamp_seconds(F.col("timestamp"))
    return with_flags(payloads.where(valid_payload())).withColumns(
        {"at": at, "feedback_date": F.date_format(at, "yyyy-MM-dd")})


def append_feedback(feedback: DataFrame, store: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append to the store by day.  The checkpoint and the file sink's log make this exactly-once; no
    lock and no rewriting of a day's file."""
    return (
        feedback.drop("at").writeStream.format("json").partitionBy("feedback_date")
        .option("path", store).option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def _folder(base: str, batch: int) -> str:
    return f"{base.rstrip('/')}/batch_id={batch}"


def store_feedback(payloads: DataFrame, store: str, rejects: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Every arriving payload goes to one of two places: accepted ones, with flags, to ``store`` by day, the others with the
    reason to ``rejects``.

    Each batch has a folder of its own in either place and is written over what an interrupted attempt has left there: a
    batch keeps its number and its files after a restart, so nothing is lost and nothing comes twice."""
    def both(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            accepted, rejected = split_payloads(batch)
            if CORRUPT in batch.columns:
                accepted = accepted.drop(CORRUPT)
                rejected = rejected.withColumn("error", F.when(F.col(CORRUPT).isNotNull(), "payload is not a JSON object of the expected types").otherwise(F.col("error")))
            prepared(accepted).drop("at").write.mode("overwrite").partitionBy("feedback_date").json(_folder(store, number))
            rejected.write.mode("overwrite").option("ignoreNullFields", False).json(_folder(rejects, number))
        finally:
            batch.unpersist()

    return payloads.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_daily_counts(feedback: DataFrame, path: str, checkpoint: str, lateness: str = "1 day", **trigger) -> StreamingQuery:
    """Counts of every day that is closed, appended as Parquet once; days that may still get feedback stay in the state."""
    return (
        daily_counts(feedback, lateness).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())


def store_daily_counts(feedback: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Counts of every day, open ones too: each batch writes the new totals of the days it has changed to a folder of its own,
    over what an interrupted attempt has left there.  No feedback is too late; the state is one row a day."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_folder(path, number))

    return daily_counts(feedback, None).writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """What ``store_daily_counts`` has written: the latest totals of every day."""
    stored = spark.read.schema(f"{DAILY}, batch_id bigint").parquet(path)
    totals = F.struct("total", "agreements", "false_positives")
    return stored.groupBy("feedback_date").agg(F.max_by(totals, "batch_id").alias("t")).select("feedback_date", "t.*")


DAILY = "feedback_date string, total bigint, agreements bigint, false_positives bigint"


def daily_counts(feedback: DataFrame, lateness: str | None = "1 day") -> DataFrame:
    """Totals, agreements and false positives per day; days close once the watermark has passed.  Without ``lateness`` there is
    no watermark and no day closes."""
    seen = feedback if lateness is None else feedback.withWatermark("at", lateness)
    return (
        seen.groupBy(F.window("at", "1 day").alias("day"))
        .agg(F.count("*").alias("total"), F.count_if("isAgreement").alias("agreements"),
             F.count_if("isFalsePositive").alias("false_positives"))
        .select(F.date_format("day.start", "yyyy-MM-dd").alias("feedback_date"), "total", "agreements",
                "false_positives")
    )


def redact_stream(
    units: DataFrame, rules: Sequence[Rule] = IDENTIFIER_RULES, deletion_mode: str = "delete"
) -> DataFrame:
    """Detection, plan and redaction are row-local, so they run unchanged on a stream, without state."""
    return redact_units(plan_units(detect_units(units, rules)), deletion_mode)
