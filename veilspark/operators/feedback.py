"""User feedback on review targets: validation, flags, statistics, retraining rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.grades import GRADES
from veilspark.functions.text import fixed, rounded, strip

# Feedback fields and the grades a user can choose (X: not sensitive at all).
FEEDBACK = (
    "locationLabel string, context string, aiGrade string, userGrade string, fileType string, "
    "sensitiveCategory string, reason string, userId string, timestamp double, "
    "isAgreement boolean, isFalsePositive boolean"
)
CHOICES = ("C", "S", "O", "X")


def valid_payload() -> Column:
    return (
        F.col("locationLabel").isNotNull() & F.col("context").isNotNull()
        & F.coalesce(F.col("userGrade").isin(*CHOICES), F.lit(False))
    )


def split_payloads(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``error``)."""
    error = (
        F.when(F.col("locationLabel").isNull(), "locationLabel is required")
        .when(F.col("context").isNull(), "context is required")
        .when(F.col("userGrade").isNull(), "userGrade is required")
        .when(~F.col("userGrade").isin(*CHOICES), "userGrade must be one of C, S, O, X")
    )
    return payloads.where(valid_payload()), payloads.where(~valid_payload()).withColumn("error", error)


def with_flags(feedback: DataFrame) -> DataFrame:
    return feedback.withColumns({
        "isAgreement": F.col("userGrade").eqNullSafe(F.col("aiGrade")),
        "isFalsePositive": F.coalesce(F.col("userGrade") == "X", F.lit(False)),
    })


def with_event(feedback: DataFrame) -> DataFrame:
    """Kind of event for the log: false positive, mismatch or agreement."""
    return feedback.withColumn("event", F.when(F.col("isFalsePositive"), "false_positive").when(
        ~F.col("isAgreement"), "mismatch").otherwise("agreement"))


def _counts() -> list[Column]:
    return [
        F.count("*").alias("total"),
        F.count_if(F.coalesce("isAgreement", F.lit(False))).alias("agreements"),
        F.count_if(F.coalesce("isFalsePositive", F.lit(False))).alias("false_positives"),
    ]


def overall_stats(feedback: DataFrame) -> DataFrame:
    """Totals and rates (3 digits); rates are null without any feedback."""
    t = F.col("total")
    return feedback.agg(*_counts()).select(
        "total", "agreements", "false_positives", (t - F.col("agreements")).alias("mismatches"),
        rounded(F.try_divide("agreements", t), 3).alias("agreement_rate"),
        rounded(F.try_divide("false_positives", t), 3).alias("false_positive_rate"),
        rounded(F.try_divide(t - F.col("agreements"), t), 3).alias("mismatch_rate"))


def store_stats(feedback: DataFrame) -> DataFrame:
    """Totals of the store; the rate is 0 without any feedback."""
    return overall_stats(feedback).select(
        "total", "agreements", "false_positives", F.coalesce("agreement_rate", F.lit(0.0)).alias("agreement_rate"))


def grouped_stats(feedback: DataFrame) -> DataFrame:
    """Counts by file type, by AI grade and by date (dimension, value).

    The rows are first reduced to one per combination, then spread over the three dimensions."""
    def named(c: str, missing: str) -> Column:
        return F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(missing))

    base = feedback.groupBy(
        named("fileType", "unknown").alias("file_type"), named("aiGrade", "None").alias("ai_grade"),
        F.coalesce("feedback_date", F.lit("unknown")).alias("feedback_date"),
    ).agg(*_counts())
    dims = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"))
        for d in ("file_type", "ai_grade", "feedback_date")]))
    return base.select(dims.alias("d"), "total", "agreements", "false_positives").groupBy(
        "d.dimension", "d.value").agg(
        *[F.sum(c).alias(c) for c in ("total", "agreements", "false_positives")])


def rate(count: Column, total: Column) -> Column:
    """``12.3%``, or ``N/A`` without any rows."""
    return F.when(total == 0, "N/A").otherwise(
        F.concat(fixed(count / total * 100, 1), F.lit("%")))


def rate_report(stats: DataFrame) -> DataFrame:
    return stats.withColumns({
        "agreement": rate(F.col("agreements"), F.col("total")),
        "false_positive": rate(F.col("false_positives"), F.col("total")),
    })


def mismatch_cases(feedback: DataFrame) -> DataFrame:
    return feedback.where(~F.coalesce("isAgreement", F.lit(False)))


def mismatch_report(feedback: DataFrame, *order: str, n: int = 10) -> DataFrame:
    """First mismatches with a short context, as the report shows them."""
    return mismatch_cases(feedback).orderBy(*order).limit(n).select(
        F.coalesce("aiGrade", F.lit("?")).alias("ai_grade"), F.coalesce("userGrade", F.lit("?")).alias("user_grade"),
        F.coalesce("fileType", F.lit("?")).alias("file_type"),
        F.replace(F.left(F.coalesce("context", F.lit("")), F.lit(40)), F.lit("\n"), F.lit(" ")).alias("context"))


def retrain_rows(feedback: DataFrame) -> DataFrame:
    """Training rows: the agreed grade, O for false positives, else the user's grade; rows with an
    empty context or another label are dropped."""
    agree = F.coalesce("isAgreement", F.lit(False))
    false = F.coalesce("isFalsePositive", F.lit(False))
    text = strip(F.coalesce("context", F.lit("")))
    label = F.when(agree, F.col("aiGrade")).when(false, "O").otherwise(F.col("userGrade"))
    source = F.when(agree, "agreement").when(false, "fp_correction").otherwise("grade_correction")
    return feedback.where((text != "") & label.isin(*GRADES)).select(
        text.alias("text"), label.alias("label"), source.alias("source"),
        F.struct("fileType", "locationLabel", "aiGrade", "userGrade", F.col("feedback_date").alias("date")).alias("meta"))


def retrain_counts(rows: DataFrame) -> DataFrame:
    """Rows by label and by source (kind, value, n) in one pass."""
    small = rows.groupBy("label", "source").agg(F.count("*").alias("n"))
    return small.select(
        F.explode(F.array(F.struct(F.lit("label").alias("kind"), F.col("label").alias("value")),
                          F.struct(F.lit("source").alias("kind"), F.col("source").alias("value")))).alias("k"), "n"
    ).groupBy("k.kind", "k.value").agg(F.sum("n").alias("n"))


def latest(feedback: DataFrame, date: str, limit: int = 100) -> DataFrame:
    """The last ``limit`` entries of a day in arrival order."""
    order = [c for c in ("timestamp", "arrival") if c in feedback.columns]
    last = feedback.where(F.col("feedback_date") == date).orderBy(*[F.desc(c) for c in order]).limit(limit)
    return last.orderBy(*order)
