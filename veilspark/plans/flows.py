"""End-to-end batch flows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.keywords import KeywordPack
from veilspark.functions.grades import grade_of_rank, grade_rank
from veilspark.operators import evaluation as E
from veilspark.operators import feedback as FB
from veilspark.operators import mining, modeling, redaction, units
from veilspark.operators.deid_plan import plan_detections, plan_units
from veilspark.operators.detection import detect_units, detection_rows


def document_lines(documents: DataFrame, label: bool = False) -> DataFrame:
    """Documents (doc_id, text) as line units."""
    return units.page_line_units(documents, F.col("doc_id"), F.lit(0), F.col("text"), label)


def graded_documents(planned: DataFrame) -> DataFrame:
    """Per document: lines, hits, touched lines, highest detected grade (O when nothing was found)."""
    best = F.array_max(F.transform("detections", lambda d: grade_rank(d["grade"])))
    p = planned.select("doc_id", F.size("detections").alias("h"), best.alias("best"), F.size("auto_targets").alias("a"))
    return p.groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.sum("h").alias("hits"), F.count_if(F.col("a") > 0).alias("redacted_lines"),
        F.coalesce(grade_of_rank(F.max("best")), F.lit("O")).alias("grade"))


@dataclass
class Outcome:
    """Results of an upload-like run."""

    items: DataFrame
    reviews: DataFrame
    warnings: DataFrame
    summary: DataFrame


def applied_cells(
    cells: DataFrame, names: DataFrame | None = None, predictions: DataFrame | None = None, deletion_mode: str = "mark"
) -> Outcome:
    """CSV cells: detect, plan, apply."""
    planned = plan_units(detect_units(cells, style="cell", names=names, predictions=predictions))
    items, reviews = redaction.cell_items(planned, deletion_mode), redaction.review_items(planned)
    warnings = redaction.document_warnings(items)
    return Outcome(items, reviews, warnings, redaction.summarize(items, reviews, warnings))


def guided_documents(
    document_units: DataFrame, file_type: str, names: DataFrame | None = None, predictions: DataFrame | None = None,
    deletion_mode: str = "delete", current_units: DataFrame | None = None,
) -> Outcome:
    """Documents of one type: detect, plan, guidance against the units as they are now."""
    detected = detect_units(document_units, names=names, predictions=predictions)
    targets = plan_detections(detection_rows(detected))
    now = document_units if current_units is None else current_units
    items = redaction.guide_items(targets, now, file_type, deletion_mode)
    reviews = targets.where(F.col("track") == "review")
    warnings = redaction.document_warnings(items)
    return Outcome(items, reviews, warnings, redaction.summarize(items, reviews, warnings))


def mined_candidates(files: DataFrame, pack: KeywordPack, policy: str = "current") -> DataFrame:
    """Markdown files (source_file, content) to candidate rows."""
    if policy == "first":
        u = units.markdown_blocks(files)
    else:
        u = units.markdown_units(
            files, mining.is_table_header if policy == "current" else mining.is_early_table_header)
    return mining.candidates(u, pack, policy)


def feedback_report(feedback: DataFrame) -> dict[str, DataFrame]:
    return {
        "overall": FB.overall_stats(feedback),
        "groups": FB.rate_report(FB.grouped_stats(feedback)),
        "mismatches": FB.mismatch_report(feedback, "timestamp"),
        "retrain": FB.retrain_rows(feedback),
    }


def compare_models(
    labelled: DataFrame, variants: tuple[str, ...] = ("lr_char", "svc_char", "svc_char_word_keyword"),
    key: str = "id", pack: KeywordPack | None = None, width: int = 1 << 18,
    max_iter: int | None = None,
) -> tuple[DataFrame, dict[str, modeling.GradeModel]]:
    """Train the variants on the training part and evaluate on the test part: (counts, models).  The counts are at most one
    row per model, grade and predicted grade; they are made here, so that nothing stays in the cache."""
    # Every variant trains and tests on the same stored split.
    split = modeling.stratified_split(labelled, key).persist()
    try:
        train, test = split.where("part = 'train'"), split.where("part = 'test'")
        counts, models = None, {}
        for rank, v in enumerate(variants):
            models[v] = modeling.train_grade_model(train, v, key, pack, width, max_iter)
            scored = models[v].score(test).withColumns({"model": F.lit(v), "rank": F.lit(rank)})
            c = E.confusion_counts(scored, "label", "pred", by=("model", "rank"))
            counts = c if counts is None else counts.unionByName(c)
        return labelled.sparkSession.createDataFrame(counts.collect(), counts.schema), models
    finally:
        split.unpersist()
