"""Evaluating grade predictions.  Everything derives from the (truth, prediction) counts, so the rows
are read once and reduced to at most nine of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.grades import GRADES
from veilspark.functions.text import rounded


def confusion_counts(df: DataFrame, truth: str = "truth", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """(truth, pred, n) for the rows, per ``by`` columns (a model name, say)."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_matrix(counts: DataFrame, labels: Sequence[str] = GRADES) -> DataFrame:
    """One row per true label in fixed order, one ``pred_*`` column per label, zeros included."""
    cells = counts.agg(*[
        F.coalesce(F.sum(F.when((F.col("truth") == t) & (F.col("pred") == p), F.col("n"))), F.lit(0)).alias(f"{t}|{p}")
        for t in labels for p in labels])
    return cells.select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("true_grade"), *[F.col(f"`{t}|{p}`").alias(f"pred_{p}") for p in labels])
        for t in labels])).alias("r")).select("r.*")


def _sum(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def class_report(counts: DataFrame, labels: Sequence[str] = GRADES) -> DataFrame:
    """Precision, recall, F1 and support per label; a zero denominator gives 0."""
    agg = counts.agg(*[
        x for g in labels for x in (
            _sum((F.col("truth") == g) & (F.col("pred") == g)).alias(f"tp_{g}"),
            _sum(F.col("truth") == g).alias(f"t_{g}"), _sum(F.col("pred") == g).alias(f"p_{g}"))])
    rows = agg.select(F.explode(F.array(*[
        F.struct(F.lit(g).alias("grade"), F.col(f"tp_{g}").alias("correct_count"),
                 F.col(f"t_{g}").alias("true_count"), F.col(f"p_{g}").alias("pred_count"))
        for g in labels])).alias("r")).select("r.*")
    p, r = _ratio(F.col("correct_count"), F.col("pred_count")), _ratio(F.col("correct_count"), F.col("true_count"))
    return rows.withColumns({"precision": p, "recall": r, "f1": _ratio(2 * p * r, p + r)})


def grade_report(counts: DataFrame, labels: Sequence[str] = GRADES) -> DataFrame:
    return class_report(counts, labels).select(
        "grade", "true_count", "correct_count", rounded(F.col("recall"), 6).alias("recall"))


def model_summary(counts: DataFrame, model: str = "model", labels: Sequence[str] = GRADES) -> DataFrame:
    """Per model: accuracy, recall per label, predicted labels (6 digits)."""
    hit = F.col("truth") == F.col("pred")
    return counts.groupBy(model).agg(
        rounded(_ratio(_sum(hit), F.sum("n")), 6).alias("accuracy"),
        *[rounded(_ratio(_sum(hit & (F.col("truth") == g)), _sum(F.col("truth") == g)), 6).alias(f"recall_{g}")
          for g in labels],
        *[_sum(F.col("pred") == g).alias(f"pred_{g}") for g in labels])


def best_model(summary: DataFrame, rank: str | None = None) -> DataFrame:
    """The most accurate model; of equals the first by ``rank``."""
    return summary.orderBy(F.desc("accuracy"), rank or "model").limit(1)


def misclassified(df: DataFrame, truth: str = "truth", preds: Sequence[str] = ("pred",)) -> DataFrame:
    """Rows that at least one of the models got wrong, with a Y/N flag per model."""
    wrong = [~F.col(truth).eqNullSafe(F.col(p)) for p in preds]
    any_wrong = wrong[0]
    for w in wrong[1:]:
        any_wrong = any_wrong | w
    return df.where(any_wrong).withColumns(
        {f"{p}_wrong": F.when(w, "Y").otherwise("N") for p, w in zip(preds, wrong)})


def missed(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Sensitive rows taken for open ones."""
    return df.where(F.col(truth).isin("C", "S") & (F.col(pred) == "O"))


def false_alarms(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Open rows taken for sensitive ones."""
    return df.where((F.col(truth) == "O") & F.col(pred).isin("C", "S"))


# Sentences about grades and procedures that a model has to leave open.
REGRESSION_SENTENCES = (
    "기간의 경과 등으로 비공개 필요성이 소멸된 정보",
    "O 등급 C 등급",
    "S 등급",
    "(비식별화 조치 내역 및 결과)",
    "5) S등급 데이터 비식별화 조치 결과 검토 및 승인",
    "C등급은 외부 공개 시 기관에 중대한 피해를 줄 수 있는 기밀 정보입니다",
    "정보 등급별 외부 AI 활용 가능 여부를 확인하시기 바랍니다",
    "비공개 분류 기준 검토서를 제출했습니다",
)


def regression_set(spark: SparkSession) -> DataFrame:
    """(text, label): the regression sentences and the grade they should get."""
    return spark.createDataFrame([(s, "O") for s in REGRESSION_SENTENCES], "text string, label string")


def regressions(scored: DataFrame, expected: str = "O", pred: str = "pred") -> DataFrame:
    """Rows of a regression set that did not get the expected grade."""
    return scored.where(~F.col(pred).eqNullSafe(F.lit(expected)))
