"""One query per operator or operator family, over whole driver tables."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import hits as H
from veilspark.functions import keywords as K
from veilspark.functions import location as L
from veilspark.functions import text as T
from veilspark.functions.rules import IDENTIFIER_RULES, MINING_RULES
from veilspark.operators import curation, deid_plan, detection, evaluation, feedback, mining, modeling, redaction, units
from veilspark.plans import flows
from veilspark.sources import delimited, routing
from veilspark.sources.tables import spread
from veilspark_checks import derived as D
from veilspark_checks.derived import table

Query = Callable[[SparkSession, str], DataFrame]


# Keyword pack for the manual-like lines; packs are parameters.
PACK = K.KeywordPack(
    roles={
        "strong_procedural": ["복구 절차", "카드 리셋", "원격 투입", "차단기 원격 투입", "전원 투입 순서"],
        "ambiguous_action": ["장애", "복구", "점검", "투입"],
        "operational_anchor": ["장비", "회선", "서버", "차단기"],
        "s_business_sensitive": ["계약 금액", "단가", "내부 보고"],
        "weak": ["확인", "상태", "정상", "표시", "기준"],
    },
    c_groups={"recovery": ["복구 절차", "카드 리셋"], "switching": ["원격 투입"]},
    s_group=["단가", "계약 금액"],
)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return flows.document_lines(table(spark, sf, "documents"))


def _hit_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", "unit_no", "ord", "rule", "label", F.col("start").alias("hit_start"), F.col("end").alias("hit_end"),
        "value", "grade", "action")


# --- detection -----------------------------------------------------------------------------------------

def document_hits(spark, sf):
    return _hit_columns(detection.detect_patterns(_lines(spark, sf).select("doc_id", "unit_no", "text")))


def document_identifiers(spark, sf):
    return _hit_columns(detection.detect_identifiers(_lines(spark, sf).select("doc_id", "unit_no", "text")))


def conversation_identifiers(spark, sf):
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit_no"), "text")
    return _hit_columns(detection.detect_identifiers(t))


def contact_hits(spark, sf):
    return _hit_columns(detection.detect_patterns(D.contacts(spark, sf)))


def contact_identifiers(spark, sf):
    return _hit_columns(detection.detect_identifiers(D.contacts(spark, sf)))


def rule_hits_by_language(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "text")
    return detection.detect_identifiers(docs).groupBy("lang", "rule").agg(F.count("*").alias("hits"))


def document_grades(spark, sf):
    found = detection.detect_units(D.contacts(spark, sf))
    g = found.select("doc_id", F.explode_outer("detections.grade").alias("grade"))
    from veilspark.functions.grades import document_grade

    return g.groupBy("doc_id").agg(document_grade(F.col("grade")).alias("grade"), F.count("grade").alias("hits"))


def _name_outputs(spark, sf) -> DataFrame:
    """Name-recognition output per customer: the name's span with varying labels and scores."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("doc_id"), k.alias("unit_no"), F.lit(0).alias("span_no"),
        F.when(k % 6 == 0, None).when(k % 6 == 1, "B-PER").when(k % 6 == 2, "PS").when(k % 6 == 3, "ORG")
        .when(k % 6 == 4, "per").otherwise("인명").alias("entity_group"),
        F.when(k % 2 == 0, "I-PERSON").alias("entity"), F.col("c_name").alias("word"),
        F.lit(None).cast("string").alias("text"), F.when(k % 11 != 0, 3).alias("start"),
        F.when(k % 13 == 0, 5).otherwise(3 + F.length("c_name")).alias("end"),
        F.when(k % 7 == 0, None).otherwise((k % 100) / 100.0).alias("score"))


def adapted_name_spans(spark, sf):
    return detection.adapt_name_spans(_name_outputs(spark, sf)).drop("span_no").withColumnsRenamed(
        {"start": "hit_start", "end": "hit_end"})


def name_detections(spark, sf):
    d = detection.name_detections(detection.adapt_name_spans(_name_outputs(spark, sf)), 0.5)
    return d.drop("span_no").withColumnsRenamed({"start": "hit_start", "end": "hit_end"})


def inline_name_detections(spark, sf):
    near = _name_outputs(spark, sf).drop("text").join(D.contacts(spark, sf), ["doc_id", "unit_no"])
    out = None
    for style in ("document", "cell", "sheet"):
        d = detection.inline_name_detections(near, F.col("text"), 0.4, style).drop("span_no").withColumn("style", F.lit(style))
        out = d if out is None else out.unionByName(d)
    return out.select("style", "doc_id", "unit_no", "matched", F.col("start").alias("hit_start"),
                      F.col("end").alias("hit_end"), "reason")


def _predictions(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    a, b, c = (k * 7) % 101 + 1, (k * 13) % 89 + 1, (k * 29) % 97 + 1
    t = (a + b + c).cast("double")
    p = table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("doc_id"), k.alias("unit_no"),
        F.array(a / t, b / t, c / t).alias("probability"))
    return detection.regroup_probabilities(p).drop("probability")


def class_probabilities(spark, sf):
    return _predictions(spark, sf)


def hold_policy(spark, sf):
    p = _predictions(spark, sf).join(D.notes(spark, sf), ["doc_id", "unit_no"]).withColumn(
        "text", F.when(F.col("unit_no") % 10 == 0, F.lit(" 짧음 ")).otherwise(F.col("text")))
    return detection.hold_policy(p, threshold=0.5).drop("text", "p_c", "p_s", "p_o")


def context_detections(spark, sf):
    return detection.context_detections(_predictions(spark, sf), 0.45, "cell").select(
        "doc_id", "unit_no", "grade", "sensitive_category", "reason")


def classifier_gate(spark, sf):
    """Which lines a classifier sees: Latin-script variant of the gate over the documents, Hangul over
    the contact notes."""
    latin = _lines(spark, sf).select(
        F.lit("documents").alias("source"),
        detection.skips_classifier(F.col("text"), script="[^a-zA-Z]", min_share=0.7).alias("skipped"))
    hangul = D.notes(spark, sf).select(
        F.lit("notes").alias("source"), detection.skips_classifier(F.col("text"), min_share=0.15).alias("skipped"))
    return latin.unionByName(hangul).groupBy("source", "skipped").agg(F.count("*").alias("n"))


def _mixed_detections(spark, sf) -> DataFrame:
    """Contacts with patterns, names and predictions joined in."""
    return detection.detect_units(
        D.contacts(spark, sf), names=_name_outputs(spark, sf), predictions=_predictions(spark, sf), name_threshold=0.3)


def joined_detections(spark, sf):
    """Notes with patterns, names and classifier output: counts by source and first order numbers."""
    d = detection.detect_units(
        D.notes(spark, sf).withColumn("text", F.when(F.col("unit_no") % 4 == 0, F.lit("담당 업무 절차와 장비 구성 방식을 정리한 문서"))
                                      .otherwise(F.col("text"))),
        names=_name_outputs(spark, sf), predictions=_predictions(spark, sf), name_threshold=0.3, context_threshold=0.4)
    return d.select("doc_id", "unit_no", F.explode(T.rows_of(F.col("detections"))).alias("d")).select(
        "doc_id", "unit_no", F.col("d.ord").alias("ord"), F.col("d.source").alias("source"), F.col("d.label").alias("label"),
        F.col("d.matched").alias("matched"), F.col("d.grade").alias("grade"))


def scorer_failures(spark, sf):
    """Units whose name or sentence scorer failed, per document: failures come as error rows or, for the sentence scorer, as
    missing rows of units it should have seen."""
    k = F.col("unit_no")
    names = _name_outputs(spark, sf).withColumn("error", F.when(k % 9 == 0, "timeout"))
    predictions = _predictions(spark, sf).where(k % 8 != 3).withColumn("error", F.when(k % 10 == 0, "out of memory"))
    d = detection.detect_units(D.notes(spark, sf), names=names, predictions=predictions, name_threshold=0.3, context_threshold=0.4)
    return detection.scorer_failures(d)


def detector_output_aliases(spark, sf):
    """Detector rows under other column names, offsets as a pair, matches partly missing."""
    raw = detection.detect_patterns(D.contacts(spark, sf)).select(
        "doc_id", "unit_no", F.col("label").alias("detectedLabel"),
        F.when(F.col("unit_no") % 3 > 0, F.col("value")).alias("match"),
        F.when(F.col("unit_no") % 2 == 0, F.col("start")).alias("startIndex"),
        F.when(F.col("unit_no") % 2 == 0, F.col("end")).alias("endIndex"),
        F.when(F.col("unit_no") % 5 > 0, F.array("start", "end")).alias("span"), F.col("grade").alias("csoGrade"))
    n = detection.normalize_detector_output(raw, D.contacts(spark, sf))
    return n.select("doc_id", "unit_no", "label", "matched", F.col("start").alias("hit_start"),
                    F.col("end").alias("hit_end"), "grade", "action", "sensitive_category", "reason")


# --- plan and redaction ------------------------------------------------------------------------------------

def _target_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", "unit_no", "label", "matched", "grade", "action", "source", F.col("start").alias("hit_start"),
        F.col("end").alias("hit_end"), "reason")


def contact_plan(spark, sf):
    p = deid_plan.plan_units(detection.detect_units(D.contacts(spark, sf)))
    return _target_columns(p.select("doc_id", "unit_no", F.inline(T.rows_of(F.col("auto_targets")))))


def _located(u: DataFrame) -> DataFrame:
    return u.withColumn("loc", L.location(
        fileType=F.lit("pdf"), section=F.lit("text_line"), pageNo=F.lit(0), lineNo=F.col("unit_no"))
    ).withColumn("location_label", L.unit_label("pdf", F.col("loc"), F.col("text")))


def contact_plan_from_rows(spark, sf):
    rows = detection.detection_rows(detection.detect_units(_located(D.contacts(spark, sf))))
    t = deid_plan.plan_detections(rows, places=False)
    return _target_columns(t.where("track = 'auto'").withColumn("unit_no", F.col("slot.unit_no")))


def mixed_plan(spark, sf):
    """Plan over patterns, names and classifier output: rows by track, source and label."""
    p = deid_plan.plan_units(_mixed_detections(spark, sf))
    auto = p.select("doc_id", "unit_no", F.lit("auto").alias("track"), F.inline(T.rows_of(F.col("auto_targets"))))
    review = p.select("doc_id", "unit_no", F.lit("review").alias("track"), F.inline(T.rows_of(F.col("review_targets"))))
    return auto.unionByName(review).groupBy("track", "source", "label", "action").agg(F.count("*").alias("n"))


def plan_summary_grade(spark, sf):
    rows = detection.detection_rows(detection.detect_units(_located(D.notes(spark, sf))))
    return deid_plan.summary_grade(deid_plan.plan_detections(rows, places=False))


def plan_source_counts(spark, sf):
    return deid_plan.source_counts(deid_plan.plan_units(_mixed_detections(spark, sf)))


def contact_redaction(spark, sf):
    p = deid_plan.plan_units(detection.detect_units(D.contacts(spark, sf)))
    return redaction.redact_units(p).select("doc_id", "unit_no", "applied_text")


def contact_redaction_marked(spark, sf):
    p = deid_plan.plan_units(detection.detect_units(D.contacts(spark, sf)))
    return redaction.redact_units(p, "mark").select("doc_id", "unit_no", "applied_text")


def document_redaction(spark, sf):
    """Every document line with identifiers, redacted."""
    p = deid_plan.plan_units(detection.detect_units(_lines(spark, sf)))
    r = redaction.redact_units(p)
    return r.select("doc_id", "unit_no", "text", "applied_text").where("text != applied_text")


def redacted_documents(spark, sf):
    p = deid_plan.plan_units(detection.detect_units(_lines(spark, sf)))
    return flows.graded_documents(p)


def redaction_summary(spark, sf):
    p = deid_plan.plan_units(_mixed_detections(spark, sf))
    return redaction.unit_summary(p)


def plan_applied_to_contexts(spark, sf):
    """The plan table applied to its own contexts; spans of every fifth customer are pushed out of range."""
    rows = detection.detection_rows(detection.detect_units(_located(D.notes(spark, sf))))
    t = deid_plan.plan_detections(rows)
    late = F.col("slot.unit_no") % 5 == 0
    t = t.withColumns({"start": F.when(late, F.col("start") + 200).otherwise(F.col("start")),
                       "end": F.when(late, F.col("end") + 200).otherwise(F.col("end"))})
    return redaction.apply_plan(t).select(
        "doc_id", F.col("loc.lineNo").alias("line_no"), "original_text", "applied_text",
        F.size("applied").alias("applied_n"), F.size("skipped").alias("skipped_n"),
        F.array_join("warnings", "#").alias("warnings"), F.size("plan_warnings").alias("plan_warnings"))


def _supplier_cells(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey"), F.col("s_name"),
        F.concat(F.lit("010-"), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0"), F.lit("-1234 / a"),
                 F.col("s_suppkey").cast("string"), F.lit("@s.example.org")).alias("s_contact"),
        F.when(F.col("s_suppkey") % 3 == 0, "  ").otherwise(F.concat(F.lit("192.168.1."), (F.col("s_suppkey") % 250).cast("string"))).alias("s_host"))
    return units.column_cell_units(s, "s_suppkey", ["s_name", "s_contact", "s_host"])


def cell_units(spark, sf):
    return _supplier_cells(spark, sf).select(
        "unit_no", "text", "location_label", F.col("loc.rowNo").alias("row_no"), F.col("loc.colNo").alias("col_no"),
        F.col("loc.headerName").alias("header"))


def cell_items(spark, sf):
    out = flows.applied_cells(_supplier_cells(spark, sf))
    return out.items.select(
        "location_label", "label", "action", "original_text", "applied_text", "status", "applied_target_count",
        "skipped_target_count", "grade", "source", F.size("warnings").alias("warnings"))


def cell_summary(spark, sf):
    return flows.applied_cells(_supplier_cells(spark, sf)).summary


def _guide_inputs(spark, sf, file_type: str):
    """Note units as body paragraphs or page lines, and a plan over them that has been disturbed."""
    n = F.col("unit_no").cast("int")
    loc = {
        "docx": L.location(fileType=F.lit("docx"), section=F.lit("body"), paragraphNo=n),
        "pptx": L.location(fileType=F.lit("pptx"), section=F.lit("shape_text"), slideNo=n, shapeNo=F.lit(1), paragraphNo=F.lit(0)),
        "hwpx": L.location(fileType=F.lit("hwpx"), section=F.lit("body"), sectionNo=F.lit(0), paragraphNo=n),
        "pdf": L.location(fileType=F.lit("pdf"), section=F.lit("text_line"), pageNo=F.lit(0), lineNo=n),
    }[file_type]
    u = D.notes(spark, sf).withColumn("loc", loc).withColumn(
        "location_label", L.unit_label(file_type, F.col("loc"), F.col("text")))
    t = deid_plan.plan_detections(detection.detection_rows(detection.detect_units(u)))
    no = F.col("slot.unit_no")
    lost = {"docx": "paragraphNo", "pptx": "shapeNo", "hwpx": "sectionNo", "pdf": "pageNo"}[file_type]
    moved = {"docx": "paragraphNo", "pptx": "slideNo", "hwpx": "paragraphNo", "pdf": "lineNo"}[file_type]
    t = t.withColumn("loc", F.when(no % 7 == 0, F.col("loc").withField(lost, F.lit(None).cast("int")))
                     .when(no % 7 == 1, F.col("loc").withField(moved, F.col(f"loc.{moved}") + 10_000_000))
                     .when(no % 7 == 2, F.col("loc").withField("section", F.lit("footer"))).otherwise(F.col("loc")))
    t = t.withColumn("matched", F.when(no % 7 == 3, F.concat("matched", F.lit("x"))).otherwise(F.col("matched")))
    t = t.withColumn("context", F.when(no % 7 == 4, F.concat("context", F.lit(" 수정"))).otherwise(F.col("context")))
    return t, u


def _guide_query(file_type: str) -> Query:
    def run(spark, sf):
        t, u = _guide_inputs(spark, sf, file_type)
        i = redaction.guide_items(t, u, file_type)
        code = F.transform("warnings", lambda w: F.regexp_extract(w, r"^\[([a-z_]+)\]", 1))
        return i.select(
            "doc_id", "location_label", "label", "action", "original_text", "applied_text", "status",
            "applied_target_count", "skipped_target_count", F.array_join(code, ",").alias("codes"), "grade", "source")

    return run


def _guide_warning_query(file_type: str) -> Query:
    """Full warning texts of the guide of a file type."""
    def query(spark, sf):
        t, u = _guide_inputs(spark, sf, file_type)
        return redaction.guide_items(t, u, file_type).select("doc_id", "location_label", F.explode(T.rows_of(F.col("warnings"))).alias("warning"))

    return query


def guide_summary(spark, sf):
    t, u = _guide_inputs(spark, sf, "docx")
    items = redaction.guide_items(t, u, "docx")
    return redaction.summarize(items, t.where("track = 'review'"), redaction.document_warnings(items))


def sheet_items(spark, sf):
    """Cells of every kind from the customers, targets from their notes."""
    n = D.notes(spark, sf)
    k = F.col("unit_no")
    ref = F.concat(F.lit("B"), k.cast("string"))
    cells = n.select(
        "doc_id", F.lit("연락처").alias("sheet_name"), ref.alias("cell_ref"),
        F.when(k % 8 == 1, "formula").when(k % 8 == 2, "number").when(k % 8 == 3, "empty").otherwise("string").alias("cell_type"),
        F.when(k % 8 == 4, F.lit("A1")).alias("merged_top_left"), F.when(k % 8 == 3, None).otherwise(F.col("text")).alias("text"))
    u = n.withColumn("loc", L.location(
        fileType=F.lit("xlsx"), sheetName=F.lit("연락처"), cellRef=ref)).withColumn("location_label", L.sheet_label(F.lit("연락처"), ref))
    t = deid_plan.plan_detections(detection.detection_rows(detection.detect_units(u, style="cell")))
    # The plan is disturbed afterwards: cells without a full location would count as one location.
    no = F.col("slot.unit_no")
    t = t.withColumn("loc", F.when(no % 8 == 5, F.col("loc").withField("sheetName", F.lit(None).cast("string")))
                     .when(no % 8 == 6, F.col("loc").withField("sheetName", F.lit("없는시트")))
                     .when(no % 16 == 7, F.col("loc").withField("cellRef", F.lit(None).cast("string"))).otherwise(F.col("loc")))
    i = redaction.sheet_items(t, cells)
    return i.select(
        "doc_id", "location_label", "label", "action", "original_text", "applied_text", "status", "applied_target_count",
        "skipped_target_count", F.array_join(F.transform("warnings", lambda w: F.regexp_extract(w, r"^\[([a-z_]+)\]", 1)), ",").alias("codes"),
        "grade", "source")


def review_items(spark, sf):
    p = deid_plan.plan_units(detection.detect_units(
        _located(D.notes(spark, sf).withColumn("text", F.concat(F.lit("업무 담당 부서 "), (F.col("unit_no") % 10).cast("string"), F.lit(" 내부 검토 자료")))),
        predictions=_predictions(spark, sf), context_threshold=0.4))
    return redaction.review_items(p).select(
        "doc_id", "unit_no", "location_label", "label", "action", "context", "grade", "sensitive_category", "source")


# --- units ----------------------------------------------------------------------------------------------------

def line_units(spark, sf):
    return flows.document_lines(table(spark, sf, "documents"), label=True).select(
        "doc_id", F.col("loc.lineNo").alias("line_no"), "text", "location_label")


def extraction_stats(spark, sf):
    c = table(spark, sf, "conversations")
    return units.extraction_stats(c, F.col("conv_id"), F.col("turn"), F.when(F.col("turn") % 3 == 2, F.lit(" \n ")).otherwise(F.col("text"))).withColumn(
        "empty_pages", F.array_join(F.transform("empty_pages", lambda p: p.cast("string")), ","))


def _elements(spark, sf) -> DataFrame:
    """Conversations as element tables: user turns are body text, assistant turns table cells hosted by
    the user turn before; every line is an element."""
    c = table(spark, sf, "conversations")
    e = c.select("conv_id", "turn", "role", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
    user = F.col("role") == "user"
    text = F.when((F.col("turn") + F.col("line_no")) % 4 == 3, F.lit("  ")).otherwise(F.col("line"))
    return e.select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") * 100_000 + F.col("line_no")).cast("bigint").alias("seq"),
        F.when(user, "body").otherwise("table_cell").alias("kind"), F.lit(0).alias("section_no"),
        ((F.col("turn") - 1) * 100_000).cast("bigint").alias("host_seq"), F.when(~user, F.col("turn").cast("int")).alias("table_no"),
        F.when(~user, (F.col("line_no") / 2).cast("int")).alias("row_no"), F.when(~user, F.lit(0)).alias("col_no"), text.alias("text"))


def paragraph_units(spark, sf):
    return units.paragraph_units(_elements(spark, sf)).select(
        "doc_id", "unit_no", F.col("loc.section").alias("section"), F.col("loc.paragraphNo").alias("paragraph_no"),
        F.col("loc.tableNo").alias("table_no"), F.col("loc.rowNo").alias("row_no"), "location_label")


def section_units(spark, sf):
    return units.section_units(_elements(spark, sf)).select(
        "doc_id", "unit_no", F.col("loc.section").alias("section"), F.col("loc.paragraphNo").alias("paragraph_no"),
        F.col("loc.cellParagraphNo").alias("cell_paragraph_no"), "preceding_text", "location_label")


def slide_units(spark, sf):
    e = _elements(spark, sf)
    no = F.floor(F.col("seq") / 100_000).cast("int")
    e = e.select(
        "doc_id", "seq", F.lit(0).alias("slide_no"),
        F.when((F.col("kind") == "body") & (no % 4 == 2), "notes").when(F.col("kind") == "body", "shape_text").otherwise("table_cell").alias("kind"),
        (no % 3).alias("group_depth"), F.when(no % 3 == 1, no).alias("group_shape_no"), no.alias("shape_no"), "row_no", "col_no",
        ((F.col("kind") == "table_cell") & (F.col("seq") % 100_000 == 0)).alias("first_of_table"), "text")
    return units.slide_units(e).select(
        "doc_id", "unit_no", F.col("loc.section").alias("section"), F.col("loc.paragraphNo").alias("paragraph_no"),
        F.col("loc.tableIndex").alias("table_index"), F.col("loc.shapeNo").alias("shape_no"), "location_label")


def location_keys(spark, sf):
    """Grouping keys and their fallbacks."""
    u = D.notes(spark, sf)
    k = F.col("unit_no")
    loc = F.when(k % 4 == 0, L.location(fileType=F.lit("csv"), rowNo=k.cast("int"), colNo=F.lit(2)))
    label = F.when(k % 4 == 1, F.concat(F.lit("라벨 "), (k % 50).cast("string")))
    context = F.when(k % 4 == 2, F.col("text"))
    key = L.location_key(loc, label, context, k)
    return u.select("doc_id", "unit_no", key.alias("loc_key"))


def _markdown_files(spark, sf) -> DataFrame:
    """Documents as Markdown: some lines become headings, bold titles, page comments or table rows."""
    def mark(x: Column, i: Column) -> Column:
        return (
            F.when(i % 11 == 0, F.concat(F.lit("## "), F.left(x, F.lit(20))))
            .when(i % 11 == 3, F.concat(F.lit("### "), F.left(x, F.lit(15))))
            .when(i % 11 == 5, F.concat(F.lit("**"), F.replace(F.left(x, F.lit(12)), F.lit("*")), F.lit("** :")))
            .when(i % 11 == 7, F.concat(F.lit("<!-- page "), i.cast("string"), F.lit(" -->")))
            .when(i % 11 == 8, F.concat(F.lit("| "), F.left(x, F.lit(10)), F.lit(" | "), F.substring(x, 11, 10), F.lit(" |")))
            .when(i % 11 == 9, F.lit("|---|:-:|"))
            .otherwise(x)
        )

    return table(spark, sf, "documents").select(
        F.concat(F.lit("manual "), F.col("doc_id").cast("string"), F.lit(".v1.md")).alias("source_file"),
        F.array_join(F.transform(T.lines(F.col("text")), mark), "\n").alias("content"))


def markdown_units(spark, sf):
    u = units.markdown_units(_markdown_files(spark, sf), mining.is_table_header)
    return u.withColumn("unit_id", units.unit_id(F.col("source_file"), F.col("heading_path"), F.col("text")))


def markdown_line_units(spark, sf):
    """The same units from a table of lines, as files larger than a row are read."""
    files = _markdown_files(spark, sf)
    lines = files.select("source_file", F.posexplode(F.split("content", "\n")).alias("line_no", "text"))
    return units.markdown_line_units(lines, mining.is_table_header, run=100)


def markdown_blocks(spark, sf):
    return units.markdown_blocks(_markdown_files(spark, sf))


# --- mining -----------------------------------------------------------------------------------------------------

def _manual_files(spark, sf) -> DataFrame:
    """Manual lines grouped into files of ten parts each."""
    lines = table(spark, sf, "part").select(
        F.floor(F.col("p_partkey") / 40).cast("bigint").alias("f"), "p_partkey", F.expr(D.MANUAL_LINE).alias("line"))
    return lines.groupBy("f").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "\n").alias("content")).select(
        F.concat(F.lit("manual "), F.col("f").cast("string"), F.lit(".md")).alias("source_file"), "content")


def noise_rules(spark, sf):
    """First noise rule per manual-like line."""
    return D.manual_lines(spark, sf).select(
        "line_no", mining.noise_reason(F.col("line"), F.col("source_file")).alias("reason"),
        mining.is_noise(F.col("line"), F.col("source_file"), "second").alias("noise_before"),
        mining.is_schedule(F.col("line")).alias("schedule"), mining.compact(F.col("line")).alias("compacted"),
        units.is_table_row(F.col("line")).alias("table_row"))


def document_noise(spark, sf):
    """Noise reasons over the document lines."""
    return _lines(spark, sf).groupBy(
        F.coalesce(mining.noise_reason(F.col("text"), F.lit("")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def keyword_matches(spark, sf):
    norm = K.normalized(F.col("line"))
    d = D.manual_lines(spark, sf).select("line_no", norm.alias("norm"))
    out = None
    for role in K.ROLE_TRACKS:
        m = d.select("line_no", F.explode(K.role_matches(F.col("norm"), PACK, role)).alias("m")).select(
            "line_no", "m.kw", "m.track", "m.role")
        out = m if out is None else out.unionByName(m)
    return out


def mined_candidates(spark, sf):
    c = flows.mined_candidates(_manual_files(spark, sf), PACK)
    reason = F.from_json("candidateReason", "array<struct<kw:string,label:string,track:string,`group`:string,role:string>>")
    return c.withColumn("reasons", F.array_join(F.transform(
        reason, lambda r: F.concat(r["role"], F.lit(":"), r["kw"])), "|")).drop("candidateReason", "unit_no")


def mined_candidates_second_policy(spark, sf):
    c = flows.mined_candidates(_manual_files(spark, sf), PACK, "second")
    return c.select("sourceFile", "unitId", "text", "candidateType", "regexOnly", "suggestedGrade", "priorityScore")


def mined_candidates_first_policy(spark, sf):
    c = flows.mined_candidates(_manual_files(spark, sf), PACK, "first")
    return c.select("sourceFile", "unitId", "candidateType", "regexOnly", F.length("text").alias("chars"))


def mining_counts(spark, sf):
    u = units.markdown_units(_manual_files(spark, sf), mining.is_table_header)
    return mining.mining_counts(u, PACK)


def mining_cutoff(spark, sf):
    return mining.cutoff_score(flows.mined_candidates(_manual_files(spark, sf), PACK), 100)


def mining_review_order(spark, sf):
    """Candidates with their place in the review order."""
    c = mining.with_review_rank(flows.mined_candidates(_manual_files(spark, sf), PACK))
    return c.select("sourceFile", "unit_no", "priorityScore", "strongKeywordCount", "priorityBand", "reviewRank")


# --- curation --------------------------------------------------------------------------------------------------

def _dirty_documents(spark, sf) -> DataFrame:
    """Whole documents with bullets, slashes, brackets and error cells worked in."""
    k = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", F.when(k % 50 == 0, F.lit(" #REF! ")).when(k % 50 == 1, None).otherwise(
        F.concat(F.lit("① A/S ( 점검 ) / 목록 ◆ ( ) 값 1/2 /끝 ."), F.replace(F.replace("text", F.lit(". "), F.lit(" / ")), F.lit(", "), F.lit(" ( "))))
        .alias("text"))


def clean_text(spark, sf):
    return curation.clean_dataset(_dirty_documents(spark, sf)).select("doc_id", "text")


def cleaning_counts(spark, sf):
    return curation.cleaning_counts(curation.clean_dataset(_dirty_documents(spark, sf)))


def label_issues(spark, sf):
    return curation.label_issues(D.labelled_rows(spark, sf))


def label_value_counts(spark, sf):
    return curation.value_counts(D.labelled_rows(spark, sf), [*curation.FLAG_COLUMNS, "cso_grade"])


def top_categories(spark, sf):
    return curation.top_values(D.labelled_rows(spark, sf), "sensitive_category", 20)


def document_profile(spark, sf):
    return curation.null_counts(_dirty_documents(spark, sf))


def text_lengths(spark, sf):
    return curation.text_lengths(table(spark, sf, "documents")).select("doc_id", "text_length")


def regraded_labels(spark, sf):
    return curation.regrade(D.labelled_rows(spark, sf)).select("id", "original_grade", "label", "remap_reason")


def _reviewed(spark, sf) -> DataFrame:
    return D.feedback_rows(spark, sf).select(
        F.col("context").alias("text"), F.concat(F.lit(" "), F.lower("userGrade")).alias("userGrade"),
        F.col("fileType").alias("sourceFile"), F.when(F.col("timestamp") % 3 == 0, "1").alias("augmented"))


def merged_training_set(spark, sf):
    return curation.merged_training_set(D.labelled_rows(spark, sf), _reviewed(spark, sf))


def regrade_audit(spark, sf):
    return curation.regrade_audit(curation.regrade(D.labelled_rows(spark, sf)))


def changed_rows(spark, sf):
    """The first regraded rows whose grade changed (a report of fixed length)."""
    return curation.changed_sample(curation.regrade(D.labelled_rows(spark, sf)), "id").select("id", "original_grade", "label")


def appended_rows(spark, sf):
    """Feedback contexts appended to the labelled rows with continued ids."""
    old = D.labelled_rows(spark, sf).select("id", "text", "cso_grade")
    new = D.feedback_rows(spark, sf).select(F.lit(None).cast("string").alias("id"), F.col("context").alias("text"),
                                            F.lit("O").alias("cso_grade"), F.col("timestamp").cast("bigint").alias("seq"))
    return curation.append_rows(old, new, "seq")


def failed_expectations(spark, sf):
    rows = curation.regrade(D.labelled_rows(spark, sf))
    return curation.failed_expectations(rows, {"en src1": "C", "fr src2": "O", "없는 문장": "S"}, "id")


# --- models and evaluation -----------------------------------------------------------------------------------------

def char_ngram_counts(spark, sf):
    return modeling.token_counts(table(spark, sf, "benchmark"), "item_id", kind="char_wb")


def whole_text_ngram_counts(spark, sf):
    return modeling.token_counts(table(spark, sf, "benchmark"), "item_id", kind="char")


def word_ngram_counts(spark, sf):
    return modeling.token_counts(table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), "id", kind="word")


def word_tfidf(spark, sf):
    return modeling.tfidf(table(spark, sf, "documents"), "doc_id", kind="word").groupBy("doc_id").agg(
        F.count("*").alias("terms"), F.sum("tf").alias("tokens"), F.round(F.sum("weight"), 6).alias("weight_sum"),
        F.round(F.max("weight"), 6).alias("weight_max"))


def char_tfidf(spark, sf):
    """Weights of the word-bounded character n-grams of every benchmark text."""
    return modeling.tfidf(table(spark, sf, "benchmark"), "item_id").withColumn("weight", F.round("weight", 6))


def keyword_features(spark, sf):
    return modeling.keyword_counts(D.manual_lines(spark, sf).withColumnRenamed("line", "text"), PACK).drop("source_file", "text")


def stratified_split(spark, sf):
    rows = curation.regrade(D.labelled_rows(spark, sf)).select(
        "id", "label", F.when(F.col("id").cast("bigint") % 11 == 0, "1").otherwise("0").alias("augmented"))
    return modeling.stratified_split(rows.where(F.col("label").isin("C", "S", "O")), "id").select("id", "label", "part")


def shuffled_split(spark, sf):
    return modeling.shuffled_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


def balanced_weights(spark, sf):
    rows = curation.regrade(D.labelled_rows(spark, sf)).select("id", "label")
    return modeling.with_balanced_weight(rows).select("id", "label", F.round("weight", 6).alias("weight"))


def _graded_pairs(spark, sf) -> DataFrame:
    """Truth from the labels, prediction A from the detected grade, prediction B from length and language."""
    truth = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "C").when(F.col("quality") == 0, "S").otherwise("O").alias("truth"))
    graded = flows.graded_documents(deid_plan.plan_units(detection.detect_units(_lines(spark, sf)))).select("doc_id", F.col("grade").alias("pred"))
    other = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") % 5 == 0, "C").when(F.col("n_chars") % 5 == 1, "S").otherwise("O").alias("pred_b"))
    return truth.join(graded, "doc_id").join(other, "doc_id")


def confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(evaluation.confusion_counts(_graded_pairs(spark, sf), pred="pred_b"))


def class_report(spark, sf):
    r = evaluation.class_report(evaluation.confusion_counts(_graded_pairs(spark, sf), pred="pred_b"))
    return r.select("grade", "correct_count", "true_count", "pred_count", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def grade_report(spark, sf):
    return evaluation.grade_report(evaluation.confusion_counts(_graded_pairs(spark, sf), pred="pred_b"))


def _two_models(spark, sf) -> DataFrame:
    g = _graded_pairs(spark, sf)
    return g.select("truth", F.explode(F.array(
        F.struct(F.lit("rules").alias("model"), "pred"), F.struct(F.lit("length").alias("model"), F.col("pred_b").alias("pred")))).alias("m")).select("truth", "m.*")


def model_comparison(spark, sf):
    return evaluation.model_summary(evaluation.confusion_counts(_two_models(spark, sf), by=("model",)))


def best_model(spark, sf):
    return evaluation.best_model(evaluation.model_summary(evaluation.confusion_counts(_two_models(spark, sf), by=("model",)))).select("model", "accuracy")


def misclassified_rows(spark, sf):
    return evaluation.misclassified(_graded_pairs(spark, sf), preds=("pred", "pred_b"))


def missed_and_false_alarms(spark, sf):
    g = _graded_pairs(spark, sf)
    return evaluation.missed(g, pred="pred_b").withColumn("slice", F.lit("missed")).unionByName(
        evaluation.false_alarms(g, pred="pred_b").withColumn("slice", F.lit("false_alarm"))).select("doc_id", "slice")


def grade_model_scores(spark, sf):
    """Logistic model on word-bounded n-grams, trained on the labelled documents, scoring every document.
    No SQL form: the rows are scored by an optimiser's result."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    truth = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "C").when(F.col("quality") == 0, "S").otherwise("O").alias("label"))
    train = docs.join(truth, "doc_id")
    m = modeling.train_grade_model(train, "lr_char", "doc_id")
    return m.score(docs).select("doc_id", "pred", F.round("confidence", 3).alias("confidence"))


# --- feedback ------------------------------------------------------------------------------------------------------

def feedback_flags(spark, sf):
    return feedback.with_event(D.feedback_rows(spark, sf)).select(
        F.col("timestamp").cast("bigint").alias("doc_id"), "aiGrade", "userGrade", "isAgreement", "isFalsePositive", "event")


def feedback_overall(spark, sf):
    return feedback.overall_stats(D.feedback_rows(spark, sf))


def feedback_store_stats(spark, sf):
    return feedback.store_stats(D.feedback_rows(spark, sf))


def feedback_groups(spark, sf):
    return feedback.grouped_stats(D.feedback_rows(spark, sf))


def feedback_rates(spark, sf):
    return feedback.rate_report(feedback.grouped_stats(D.feedback_rows(spark, sf))).select("dimension", "value", "agreement", "false_positive")


def feedback_mismatches(spark, sf):
    return feedback.mismatch_report(D.feedback_rows(spark, sf), "timestamp")


def retrain_set(spark, sf):
    r = feedback.retrain_rows(D.feedback_rows(spark, sf))
    return r.select("text", "label", "source", F.col("meta.fileType").alias("file_type"), F.col("meta.date").alias("date"))


def retrain_counts(spark, sf):
    return feedback.retrain_counts(feedback.retrain_rows(D.feedback_rows(spark, sf)))


def feedback_latest(spark, sf):
    return feedback.latest(D.feedback_rows(spark, sf), "2026-05-05", 5).select(F.col("timestamp").cast("bigint").alias("doc_id"), "context")


def feedback_rejects(spark, sf):
    base = D.feedback_rows(spark, sf)
    k = F.col("timestamp").cast("bigint")
    p = base.withColumns({
        "locationLabel": F.when(k % 31 == 0, None).otherwise(F.col("locationLabel")),
        "userGrade": F.when(k % 37 == 0, "Q").when(k % 43 == 0, None).otherwise(F.col("userGrade"))})
    ok, bad = feedback.split_payloads(p)
    return ok.withColumn("error", F.lit("")).unionByName(bad).groupBy("error").agg(F.count("*").alias("n"))


def routed_files(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("/in.v1/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.expr(
        "case p_partkey % 7 when 0 then '.XLSX' when 1 then '.csv' when 2 then '.docx' when 3 then '.hwp' when 4 then '' when 5 then '.tar.pdf' else '.pptx' end")).alias("path"))
    return routing.route_files(p)


def delimited_rows(spark, sf):
    """All documents written as files with commas and with semicolons, line breaks and quotes inside cells, and read back."""
    docs = table(spark, sf, "documents").withColumn("cells", F.array(
        F.col("doc_id").cast("string"), "lang", F.coalesce("text", F.lit("")), F.concat(F.lit('"'), "source", F.lit('", ;'))))
    place = _scratch(spark, "delimited")
    for name, d, odd in (("commas", ",", 0), ("semicolons", ";", 1)):
        # The shortest texts come first: the start of a file has to show its delimiter.
        docs.where(F.col("doc_id") % 2 == odd).sortWithinPartitions(F.char_length("text"), "doc_id").select(
            delimited.csv_line(F.col("cells"), d).alias("value")).write.option("lineSep", "\r\n").text(f"{place}/{name}")
    rows = delimited.read_delimited(spark, [f"{place}/commas", f"{place}/semicolons"])
    return rows.select(F.get("cells", F.lit(0)).cast("bigint").alias("doc_id"), F.size("cells").alias("n_cells"), "delimiter", F.get("cells", F.lit(1)).alias("lang"),
                       F.md5(F.get("cells", F.lit(2))).alias("text_md5"), F.get("cells", F.lit(3)).alias("source"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the cluster's shared checkpoint folder, or a local one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        import uuid

        return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return tempfile.mkdtemp(prefix=f"spark-{name}-")


def streamed_daily_feedback(spark, sf):
    """Feedback derived from the event stream, counted per day by the streaming aggregation, open days included."""
    from veilspark.streaming import feedback_stream as S

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    k = F.col("event_id")
    payloads = events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("locationLabel"), F.col("event_type").alias("context"),
        F.when(k % 3 == 0, "C").when(k % 3 == 1, "S").otherwise("O").alias("aiGrade"),
        F.when(k % 5 == 0, "X").when(k % 5 == 1, "S").when(k % 5 == 2, "C").when(k % 17 == 3, "?").otherwise("O").alias("userGrade"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us")).withColumn("timestamp", F.col("us") / 1e6).drop("us")
    place = _scratch(spark, "daily")
    S.store_daily_counts(S.prepared(payloads), f"{place}/out", f"{place}/check").awaitTermination()
    return S.read_daily_counts(spark, f"{place}/out")


def streamed_feedback_store(spark, sf):
    """Feedback derived from the event stream, stored by day or rejected with a reason, then counted from both places."""
    from veilspark.streaming import feedback_stream as S

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    k = F.col("event_id")
    payloads = events.select(
        F.when(k % 31 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("locationLabel"), F.col("event_type").alias("context"),
        F.when(k % 3 == 0, "C").when(k % 3 == 1, "S").otherwise("O").alias("aiGrade"),
        F.when(k % 43 == 0, None).when(k % 5 == 0, "X").when(k % 5 == 1, "S").when(k % 17 == 3, "?").otherwise("O").alias("userGrade"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"))
    place = _scratch(spark, "feedback")
    S.store_feedback(payloads, f"{place}/store", f"{place}/rejects", f"{place}/check").awaitTermination()
    stored = spark.read.schema("isAgreement boolean, isFalsePositive boolean, feedback_date string").json(f"{place}/store").groupBy("feedback_date").agg(
        F.count("*").alias("n"), F.count_if("isAgreement").alias("agreements"), F.count_if("isFalsePositive").alias("false_positives"))
    rejected = spark.read.schema("error string").json(f"{place}/rejects").groupBy("error").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("bigint")
    return stored.select(F.lit("").alias("error"), "feedback_date", "n", "agreements", "false_positives").unionByName(
        rejected.select("error", F.lit("").alias("feedback_date"), "n", zero.alias("agreements"), zero.alias("false_positives")))


def streamed_redaction(spark, sf):
    """Redaction as a stateless stream over the contact texts, written as Parquet and read back."""
    from veilspark.streaming import feedback_stream as S

    there = spark.read.parquet(f"{sf}/customer.parquet")
    arriving = spark.readStream.schema(there.schema).option("pathGlobFilter", "customer.parquet").parquet(sf)
    u = spread(arriving, "c_custkey", there).select(
        F.col("c_nationkey").cast("bigint").alias("doc_id"), F.col("c_custkey").alias("unit_no"), F.expr(D.CONTACT_TEXT).alias("text"))
    out = S.redact_stream(u).select("doc_id", "unit_no", "applied_text")
    place = _scratch(spark, "redacted")
    q = out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{place}/out")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    document_hits, document_identifiers, conversation_identifiers, contact_hits, contact_identifiers, rule_hits_by_language,
    document_grades, adapted_name_spans, name_detections, inline_name_detections, class_probabilities, hold_policy,
    context_detections, classifier_gate, joined_detections, scorer_failures, detector_output_aliases, contact_plan, contact_plan_from_rows,
    mixed_plan, plan_summary_grade, plan_source_counts, contact_redaction, contact_redaction_marked, document_redaction,
    redacted_documents, redaction_summary, plan_applied_to_contexts, cell_units, cell_items, cell_summary,
    guide_summary, sheet_items, review_items, line_units, extraction_stats, paragraph_units, section_units, slide_units,
    location_keys, markdown_units, markdown_line_units, markdown_blocks, noise_rules, document_noise, keyword_matches, mined_candidates,
    mined_candidates_second_policy, mined_candidates_first_policy, mining_counts, mining_cutoff, mining_review_order,
    clean_text, cleaning_counts, label_issues, label_value_counts, top_categories, document_profile, text_lengths,
    regraded_labels, merged_training_set, regrade_audit, changed_rows, appended_rows, failed_expectations, char_ngram_counts,
    whole_text_ngram_counts, word_ngram_counts, word_tfidf, char_tfidf, keyword_features, stratified_split, shuffled_split,
    balanced_weights, confusion_matrix, class_report, grade_report, model_comparison, best_model, misclassified_rows,
    missed_and_false_alarms, grade_model_scores, feedback_flags, feedback_overall, feedback_store_stats, feedback_groups, feedback_rates,
    feedback_mismatches, retrain_set, retrain_counts, feedback_latest, feedback_rejects, routed_files, delimited_rows,
    streamed_daily_feedback, streamed_feedback_store, streamed_redaction,
)}
QUERIES |= {f"guide_items_{t}": _guide_query(t) for t in ("docx", "pptx", "hwpx", "pdf")}
QUERIES |= {"guide_warnings": _guide_warning_query("pdf")} | {f"guide_warnings_{t}": _guide_warning_query(t) for t in ("docx", "pptx", "hwpx")}
