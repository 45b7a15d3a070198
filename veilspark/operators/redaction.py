"""Applying a plan: masking or deleting inside the text, guidance items, sheet-cell rules, summaries."""

from __future__ import annotations

import pandas as pd
import unicodedata
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from veilspark.functions.grades import top_grade_in
from veilspark.functions.location import BASE_LABELS, guide_gap, guide_key
from veilspark.functions.rules import DELETE, REVIEW
from veilspark.functions.text import built_once, cut, is_blank, let, needs_nfc, nfc, quoted, rows_of, strip
from veilspark.operators.detection import DETECTION, DETECTIONS

DELETE_MARKER = "(삭제됨)"
SKIPPED = f"array<struct<target:{DETECTION},reason:string>>"
RESULT = (f"struct<text:string,applied:{DETECTIONS},skipped:{SKIPPED},warnings:array<string>>")

# Warning codes.
WARNING_CODES = (
    "context_mismatch", "slice_mismatch", "unicode_normalization_mismatch", "paragraph_out_of_range",
    "missing_paragraph_no", "empty_paragraph_target", "overlap_target", "missing_sheet_name",
    "missing_cell_ref", "merged_cell_not_top_left", "formula_cell", "non_string_cell", "empty_cell",
    "sheet_not_found", "unsupported_docx_section", "missing_table_cell_location", "missing_slide_no",
    "slide_out_of_range", "shape_not_found", "unknown_section", "missing_shape_location",
    "missing_section_no", "section_out_of_range", "missing_page_no", "pdf_page_out_of_range",
    "pdf_text_block_not_found", "scanned_pdf_no_text", "pdf_encrypted",
)
# Code used when a guide location is no longer in the document.
NOT_FOUND_CODES = {
    "docx": "paragraph_out_of_range", "pptx": "slide_out_of_range",
    "hwpx": "section_out_of_range", "pdf": "pdf_text_block_not_found",
}
# Message parts.
REVIEW_REASON = "검토 필요 action은 자동 적용하지 않습니다."
NO_DOCX_LABEL = "알 수 없는 docx 위치"
NO_SPAN_REASON = "start 또는 end가 None입니다."
CONTEXTS_DIFFER = "같은 location 내 target들의 context가 서로 다릅니다. 첫 번째 context를 사용합니다."
NO_CONTEXT = "해당 location에 context가 없어 빈 문자열을 사용했습니다."


def warning(code: str, *message: Column) -> Column:
    if code not in WARNING_CODES:
        raise ValueError(f"unknown warning code {code!r}")
    return F.concat(F.lit(f"[{code}] "), *message)


def _s(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


# --- one text ---------------------------------------------------------------------------------------

def replacement(action: Column, length: Column, deletion_mode: str = "delete") -> Column:
    """Deletion leaves nothing (or a marker in ``mark`` mode), a review nothing to apply (null), every
    other action one star per character of the span."""
    a = strip(F.coalesce(action, F.lit("")))
    return (
        F.when(a == REVIEW, F.lit(None).cast("string"))
        .when(a == DELETE, DELETE_MARKER if deletion_mode == "mark" else "")
        .otherwise(F.repeat(F.lit("*"), F.greatest(length, F.lit(0))))
    )


def range_error(text: Column, start: Column, end: Column) -> Column:
    """Why a span does not fit the text; null when it does."""
    return (
        F.when(start.isNull() | end.isNull(), NO_SPAN_REASON)
        .when(start < 0, F.concat(F.lit("start가 0보다 작습니다: start="), _s(start)))
        .when(end > F.length(text), F.concat(
            F.lit("end가 원문 길이를 초과합니다: end="), _s(end), F.lit(", text_len="), _s(F.length(text))))
        .when(start >= end, F.concat(
            F.lit("start가 end보다 크거나 같습니다: start="), _s(start), F.lit(", end="), _s(end)))
    )


def _no_apply_reason(t: Column) -> Column:
    return (
        F.when(strip(F.coalesce(t["action"], F.lit(""))) == REVIEW, REVIEW_REASON)
        .when(t["start"].isNull() | t["end"].isNull(), NO_SPAN_REASON)
    )


def _named(t: Column, message: Column) -> Column:
    return F.concat(t["label"], F.lit("/"), t["matched"], F.lit(": "), message)


def _differing(t: Column, piece: Column) -> Column:
    return F.concat(F.lit("matched와 실제 text[start:end]가 다릅니다: matched="), quoted(t["matched"]), F.lit(", actual="), quoted(piece),
                    F.lit(", start="), _s(t["start"]), F.lit(", end="), _s(t["end"]))


def _apart(text: Column, falling: Column) -> Column:
    """Whether all spans, last first, lie inside the text and none meets another: then each sees the text as it was given."""
    inside = F.forall(falling, lambda t: (t["start"] >= 0) & (t["start"] < t["end"]) & (t["end"] <= F.length(text)))
    clear = F.forall(F.zip_with(falling, F.slice(falling, F.lit(2), F.greatest(F.size(falling), F.lit(1))),
                                lambda late, early: F.coalesce(early["end"] <= late["start"], F.lit(True))), lambda x: x)
    return inside & clear


def apply_to_text(text: Column, targets: Column, deletion_mode: str = "delete") -> Column:
    """Apply an array of targets to a text, last start first, each on the text as it then is.

    Spans that lie inside the text and do not meet, by far the common case, are put together in one go; only others are
    folded, each step making the text anew.

    Result struct: text, applied targets, skipped targets with reasons, warnings.  A span whose text
    differs from the expected match is applied with a warning; a span outside the text is skipped."""
    def step(acc: Column, t: Column) -> Column:
        return let(range_error(acc["text"], t["start"], t["end"]), lambda error: _applied(acc, t, error))

    def _applied(acc: Column, t: Column, error: Column) -> Column:
        now = acc["text"]
        piece = cut(now, t["start"], t["end"])
        differs = (t["matched"] != "") & (t["matched"] != piece)
        note = F.when(error.isNotNull(), error).when(
            differs,
            _differing(t, piece))
        changed = F.concat(
            F.left(now, t["start"]), replacement(t["action"], t["end"] - t["start"], deletion_mode),
            F.substring(now, t["end"] + 1, F.length(now)))
        return let(note, lambda n: F.struct(
            F.when(error.isNull(), changed).otherwise(now).alias("text"),
            F.when(error.isNull(), F.concat(acc["applied"], F.array(t))).otherwise(acc["applied"]).alias("applied"),
            F.when(error.isNull(), acc["skipped"]).otherwise(F.concat(
                acc["skipped"], F.array(F.struct(t.alias("target"), error.alias("reason"))))).alias("skipped"),
            F.when(n.isNull(), acc["warnings"]).otherwise(
                F.concat(acc["warnings"], F.array(_named(t, n)))).alias("warnings"),
        ))

    def run(ts: Column) -> Column:
        out = F.transform(F.filter(ts, lambda t: _no_apply_reason(t).isNotNull()),
                          lambda t: F.struct(t.alias("target"), _no_apply_reason(t).alias("reason")))
        ready = F.transform(
            F.array_sort(F.transform(
                F.filter(ts, lambda t: _no_apply_reason(t).isNull()),
                lambda t, i: F.struct((-t["start"]).alias("a"), i.alias("b"), t.alias("t")))),
            lambda s: s["t"])

        def chosen(p: Column) -> Column:
            begun = F.struct(
                text.alias("text"), F.array().cast(DETECTIONS).alias("applied"), p["out"].alias("skipped"),
                F.transform(p["out"], lambda s: _named(s["target"], s["reason"])).alias("warnings")).cast(RESULT)
            return F.when(_apart(text, p["ready"]), _joined(begun, p["ready"])).otherwise(F.aggregate(p["ready"], begun, step))

        return let(F.struct(out.alias("out"), ready.alias("ready")), chosen)

    def _joined(begun: Column, falling: Column) -> Column:
        """Spans that don't meet: what is between them and what replaces them, put together once."""
        def between(t: Column, i: Column, rising: Column) -> Column:
            before = F.when(i == 0, 0).otherwise(F.get(rising, i - 1)["end"])
            return F.concat(cut(text, before, t["start"]), replacement(t["action"], t["end"] - t["start"], deletion_mode))

        parts = let(F.reverse(falling), lambda rising: F.array_join(F.transform(rising, lambda t, i: between(t, i, rising)), ""))
        rest = F.when(F.size(falling) == 0, text).otherwise(cut(text, F.get(falling, F.lit(0))["end"], F.length(text)))
        notes = F.filter(F.transform(falling, lambda t: let(cut(text, t["start"], t["end"]), lambda piece: F.when(
            (t["matched"] != "") & (t["matched"] != piece), _named(t, _differing(t, piece))))), lambda w: w.isNotNull())
        return F.struct(F.concat(parts, rest).alias("text"), falling.alias("applied"), begun["skipped"].alias("skipped"),
                        F.concat(begun["warnings"], notes).alias("warnings")).cast(RESULT)

    return let(targets, run)


@built_once
def _applied_to_unit(deletion_mode: str) -> Column:
    return apply_to_text(F.col("text"), F.col("auto_targets"), deletion_mode)


def status_of(applied: Column, skipped: Column) -> Column:
    return F.when((applied > 0) & (skipped == 0), "applied").when(
        (applied > 0) & (skipped > 0), "partial").otherwise("skipped")


def _reading_order(targets: Column) -> Column:
    keyed = F.transform(targets, lambda t, i: F.struct(
        t["start"].isNull().alias("a"), t["start"].alias("b"), t["label"].alias("c"), i.alias("d"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda s: s["t"])


def distinct_values(targets: Column, field: str, reading_order: bool = True) -> Column:
    """Distinct labels or actions, ``, ``-joined, in reading order or in the given order."""
    arr = _reading_order(targets) if reading_order else targets
    return F.array_join(
        F.array_distinct(F.filter(F.transform(arr, lambda t: t[field]), lambda v: F.coalesce(v, F.lit("")) != "")), ", ")


def group_grade(targets: Column) -> Column:
    return top_grade_in(F.transform(targets, lambda t: t["grade"]))


def group_source(targets: Column) -> Column:
    names = F.array_distinct(F.filter(F.transform(targets, lambda t: t["source"]),
                                      lambda s: F.coalesce(s, F.lit("")) != ""))
    return F.when(F.size(names) == 1, F.get(names, F.lit(0))).when(F.size(names) > 1, "mixed")


# --- units carrying their own plan -----------------------------------------------------------------

def redact_units(planned: DataFrame, deletion_mode: str = "delete") -> DataFrame:
    """Every unit with its ``applied_text`` (the text itself where nothing applies).  Row-local."""
    applied = _applied_to_unit(deletion_mode)["text"]
    return planned.withColumn(
        "applied_text", F.when(F.size("auto_targets") > 0, applied).otherwise(F.col("text")))


def cell_items(planned: DataFrame, deletion_mode: str = "mark") -> DataFrame:
    """One result item per CSV cell with automatic targets.  A cell counts as applied when its text
    changed, else as skipped; labels and actions follow target order."""
    # A generator instead of a filter: Catalyst would copy the detection into a pushed-down filter.
    touched = F.explode(F.when(
        F.size("auto_targets") > 0,
        F.array(_applied_to_unit(deletion_mode))))
    r = planned.select("*", touched.alias("r"))
    return r.select(
        "doc_id", "unit_no", "location_label", "loc",
        distinct_values(F.col("auto_targets"), "label", False).alias("label"),
        distinct_values(F.col("auto_targets"), "action", False).alias("action"),
        F.col("text").alias("original_text"), F.col("r.text").alias("applied_text"),
        F.when(F.col("r.text") != F.col("text"), "applied").otherwise("skipped").alias("status"),
        F.size("r.applied").alias("applied_target_count"),
        F.size("r.skipped").alias("skipped_target_count"),
        F.col("r.warnings").alias("warnings"),
        group_grade(F.col("auto_targets")).alias("grade"),
        group_source(F.col("auto_targets")).alias("source"),
    )


def review_items(planned: DataFrame) -> DataFrame:
    """One row per review target of units carrying their plan."""
    return planned.select(
        "doc_id", "unit_no", "location_label", "loc", F.col("text").alias("context"),
        F.explode(rows_of(F.col("review_targets"))).alias("t"),
    ).select(
        "doc_id", "unit_no", "location_label", "loc",
        F.coalesce("t.label", F.lit("")).alias("label"), F.coalesce("t.action", F.lit("")).alias("action"),
        F.coalesce("context", F.lit("")).alias("context"), "t.reason", "t.grade",
        F.col("t.sensitive_type").alias("sensitive_type"),
        F.col("t.sensitive_category").alias("sensitive_category"), "t.source",
    )


# --- a plan given as a table ------------------------------------------------------------------------

_T = ["label", "matched", "grade", "action", "source", "start", "end", "sensitive_type",
      "sensitive_category", "reason"]


def _grouped_targets(rows: DataFrame, *keys: str) -> DataFrame:
    """Targets per location as one array in display order, with the first target's label and loc; ``g`` keeps each target
    with its own.  A location's targets are bounded by the text they point into."""
    item = F.struct("first_seen", F.col("start").isNull().alias("late"), F.col("start").alias("s"), "slot",
                    "location_label", "loc", "context",
                    F.struct(F.lit(0).cast("bigint").alias("ord"), *_T).cast(DETECTION).alias("t"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("g")).select(
        *keys, "g",
        F.transform("g", lambda x: x["t"]).alias("targets"),
        F.get("g", F.lit(0))["location_label"].alias("location_label"),
        F.get("g", F.lit(0))["loc"].alias("loc"),
        F.filter(F.transform("g", lambda x: x["context"]), lambda c: c.isNotNull()).alias("contexts"),
    )


def apply_plan(targets: DataFrame, deletion_mode: str = "delete") -> DataFrame:
    """Apply the automatic targets of a plan table to their own contexts: one row per location with
    original and applied text, counts, warnings and location warnings."""
    g = _grouped_targets(targets.where(F.col("track") == "auto"), "doc_id", "loc_key")
    text = F.coalesce(F.get("contexts", F.lit(0)), F.lit(""))
    return g.withColumn("text", text).withColumn(
        "r", apply_to_text(F.col("text"), F.col("targets"), deletion_mode)
    ).select(
        "doc_id", "loc_key", "location_label", "loc", F.col("text").alias("original_text"),
        F.col("r.text").alias("applied_text"), F.col("r.applied").alias("applied"),
        F.col("r.skipped").alias("skipped"), F.col("r.warnings").alias("warnings"),
        F.when(F.size("contexts") == 0, F.array(F.concat(F.col("loc_key"), F.lit(f": {NO_CONTEXT}"))))
        .when(F.size(F.array_distinct("contexts")) > 1,
              F.array(F.concat(F.col("loc_key"), F.lit(f": {CONTEXTS_DIFFER}"))))
        .otherwise(F.array().cast("array<string>")).alias("plan_warnings"),
    )


@F.pandas_udf(ArrayType(StringType()))
def _nfc_each(s: pd.Series) -> pd.Series:
    return s.map(lambda a: [None if v is None else unicodedata.normalize("NFC", v) for v in a],
                 na_action="ignore")


def _validated(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``checks``: per target null (fits) or a warning, comparing the span with the match.

    Only rows with a differing span that holds text outside the surely normalised ranges are
    normalised in Python; all others carry null through that step."""
    t = F.col(text)
    fits = lambda x: (x["start"] >= 0) & (x["end"] <= F.length(t)) & (x["start"] < x["end"])
    in_range = lambda x: F.coalesce(fits(x), F.lit(False))
    pairs = F.transform("targets", lambda x: F.struct(
        F.when(in_range(x), cut(t, x["start"], x["end"])).alias("actual"), x["matched"].alias("matched")))
    df = df.withColumn("_pairs", pairs)
    odd = F.exists("_pairs", lambda p: p["actual"].isNotNull() & (p["actual"] != p["matched"])
                   & (needs_nfc(p["actual"]) | needs_nfc(p["matched"])))
    df = df.withColumn("_norm", _nfc_each(F.when(odd, F.flatten(F.transform(
        "_pairs", lambda p: F.array(p["actual"], p["matched"]))))))

    def check(x: Column, i: Column) -> Column:
        p = F.get("_pairs", i)
        span = F.concat(F.lit("actual="), quoted(p["actual"]), F.lit(", matched="), quoted(p["matched"]),
                        F.lit(", start="), _s(x["start"]), F.lit(", end="), _s(x["end"]))
        same = F.coalesce(F.get("_norm", i * 2) == F.get("_norm", i * 2 + 1), F.lit(False))
        where = F.concat(F.col("shown_label"), F.lit(": "))
        return (
            F.when(x["start"].isNull() | x["end"].isNull(), warning("slice_mismatch", where, F.lit(NO_SPAN_REASON)))
            .when(~in_range(x), warning(
                "slice_mismatch", where, F.lit("start/end 범위가 현재 텍스트에 유효하지 않습니다: start="),
                _s(x["start"]), F.lit(", end="), _s(x["end"]), F.lit(", text_len="), _s(F.length(t))))
            .when(p["actual"] == p["matched"], F.lit(None).cast("string"))
            .when(same, warning(
                "unicode_normalization_mismatch", where,
                F.lit("text[start:end]와 matched가 원문 기준으로 일치하지 않습니다. NFC 정규화 후에만 일치하므로 "
                      "인덱스 기준 불일치 가능성이 있어 자동 적용을 건너뜁니다: "), span))
            .otherwise(warning(
                "slice_mismatch", where,
                F.lit("text[start:end]와 matched가 일치하지 않아 자동 적용을 건너뜁니다: "), span))
        )

    return df.withColumn("checks", let(F.col("targets"), lambda ts: F.transform(ts, check)))


def _entry(label: Column, loc: Column, what: Column, action: Column, original: Column, applied: Column, status: Column | str,
           n_applied: Column | int, n_skipped: Column | int, warnings: Column, grade: Column | None = None, source: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    lit = lambda v: F.lit(v) if isinstance(v, (int, str)) else v
    return F.struct(
        label.alias("location_label"), loc.alias("loc"), what.alias("label"), action.alias("action"), original.alias("original_text"),
        applied.alias("applied_text"), lit(status).alias("status"), lit(n_applied).alias("applied_target_count"),
        lit(n_skipped).alias("skipped_target_count"), warnings.alias("warnings"),
        (none if grade is None else grade).alias("grade"), (none if source is None else source).alias("source"))


def _applied_entry(df: DataFrame, what: str, deletion_mode: str) -> DataFrame:
    """Add ``entry`` for locations whose text is known: context check, span check, preview."""
    same = lambda c: F.coalesce(c == F.col("text"), F.lit(True))
    # Contexts are compared in NFC; only a plain difference makes it necessary.
    differ = F.exists("contexts", lambda c: ~same(c))
    df = df.withColumn("_ctx", _nfc_each(F.when(differ, F.concat("contexts", F.array("text")))))
    mismatch = F.coalesce(
        F.exists(F.slice("_ctx", F.lit(1), F.size("contexts")), lambda c: c != F.element_at("_ctx", -1)),
        F.lit(False))
    df = _validated(df)
    valid = F.filter("targets", lambda x, i: F.get("checks", i).isNull())
    df = df.withColumn("r", F.when(F.col("text").isNotNull(), apply_to_text(F.col("text"), valid, deletion_mode)))
    bad = F.filter("checks", lambda c: c.isNotNull())
    context_note = F.when(mismatch, F.array(warning(
        "context_mismatch", F.col("shown_label"), F.lit(f": target.context와 실제 {what} 다릅니다. "),
        F.lit(f"{what[:-1]} 기준으로 slice 검증 후 권장 여부를 판단합니다." if what.endswith("텍스트가")
              else "cell_value 기준으로 slice 검증 후 적용 여부를 판단합니다."))))
    skipped = F.size(bad) + F.size("r.skipped")
    return df.withColumn("entry", _entry(
        F.col("shown_label"), F.col("loc"), distinct_values(F.col("targets"), "label"), distinct_values(F.col("targets"), "action"),
        F.col("text"), F.col("r.text"), status_of(F.size("r.applied"), skipped), F.size("r.applied"), skipped,
        F.concat(F.coalesce(context_note, F.array().cast("array<string>")), bad, F.col("r.warnings")),
        group_grade(F.col("targets")), group_source(F.col("targets"))))


def _group_skipped(label: Column, original: Column, note: Column) -> Column:
    """One item for a whole location that nothing is applied to."""
    return F.array(_entry(
        label, F.col("loc"), distinct_values(F.col("targets"), "label"), distinct_values(F.col("targets"), "action"),
        original, original, "skipped", 0, F.size("targets"), F.array(note)))


def _each_skipped(label, note) -> Column:
    """One item for every target of ``g``; ``label`` and ``note`` are made from a target's own label and location."""
    def item(x: Column) -> Column:
        context = F.coalesce(x["context"], F.lit(""))
        return _entry(label(x), x["loc"], x["t"]["label"], x["t"]["action"], context, context, "skipped", 0, 1, F.array(note(x)))

    return F.transform("g", item)


def _own_key(key: Column) -> Column:
    """A location's key, or one of its own for a target that has none."""
    return F.coalesce(F.concat(F.lit("at:"), key), F.concat(F.lit("of:"), F.to_json(F.struct("first_seen", "slot"))))


def guide_items(targets: DataFrame, units: DataFrame, file_type: str, deletion_mode: str = "delete") -> DataFrame:
    """Guidance for documents that are not edited: per location a preview, or why there is none.

    ``targets`` is a plan table, ``units`` (doc_id, loc, text) the document as it is now.  Targets are grouped first, so the
    join moves each text once; every outcome is an expression over the joined row, so both tables are read once."""
    base = BASE_LABELS[file_type]
    mine = targets.where((F.col("track") == "auto") & (F.lower(F.col("loc.fileType")) == file_type))
    mine = mine.withColumn("key", guide_key(file_type, F.col("loc")))
    current = units.select(
        "doc_id", guide_key(file_type, F.col("loc")).alias("key"), "text"
    ).where(F.col("key").isNotNull() & ~is_blank(F.col("text")))
    grouped = _grouped_targets(mine.withColumn("own_key", _own_key(F.col("key"))), "doc_id", "own_key", "key")
    unlabelled = F.lit(NO_DOCX_LABEL) if file_type == "docx" else base(F.col("loc"))
    joined = grouped.join(current, ["doc_id", "key"], "left").withColumn("shown_label", F.coalesce("location_label", unlabelled))
    done = _applied_entry(joined, "line 텍스트가" if file_type == "pdf" else "paragraph 텍스트가", deletion_mode)

    def gap(x: Column) -> Column:
        own = x["location_label"]
        return let(guide_gap(file_type, x["loc"], _s(own) if file_type == "docx" else F.coalesce(own, base(x["loc"]))),
                   lambda g: F.concat(F.lit("["), g["code"], F.lit("] "), g["message"]))

    no_place = _each_skipped(lambda x: x["location_label"] if file_type == "docx" else F.coalesce(x["location_label"], base(x["loc"])), gap)
    where = F.col("shown_label")
    text_of = {
        "docx": (F.lit(": location=("), F.lit(")가 문서 범위를 벗어났습니다.")),
        "pdf": (F.lit(": 위치가 현재 PDF에서 발견되지 않습니다 (key=("), F.lit(")).")),
    }.get(file_type, (F.lit(f": 위치가 현재 {file_type}에서 발견되지 않습니다 (key=("), F.lit(")).")))
    shown_key = F.regexp_replace("key", r"^(\w+)", "'$1'")  # the section is shown in quotes
    not_found = _group_skipped(where, F.lit(""), warning(NOT_FOUND_CODES[file_type], where, text_of[0], shown_key, text_of[1]))
    return done.select("doc_id", F.inline(
        F.when(F.col("key").isNull(), no_place).when(F.col("text").isNull(), not_found).otherwise(F.array("entry"))))


def sheet_items(targets: DataFrame, cells: DataFrame, deletion_mode: str = "delete") -> DataFrame:
    """Result items for spreadsheet cells.

    ``cells``: doc_id, sheet_name, cell_ref, cell_type (string, formula, number, boolean, empty),
    merged_top_left (null unless merged), text.  Sheets match in NFC.  Checks in order: missing sheet
    or cell name, unknown sheet, merged cell other than the top left, empty, formula, not a string.  Every outcome is an
    expression over the joined row, so the targets are read once."""
    loc = F.col("loc")
    mine = targets.where((F.col("track") == "auto") & (F.lower(loc["fileType"]) == "xlsx"))
    sheet, cell = F.coalesce(loc["sheetName"], F.lit("")), F.coalesce(loc["cellRef"], F.lit(""))
    placed = F.when((sheet != "") & (cell != ""), F.to_json(F.struct(sheet.alias("s"), cell.alias("c"))))
    grouped = _grouped_targets(
        mine.select("*", sheet.alias("sheet_name"), cell.alias("cell_ref"), _own_key(placed).alias("own_key")),
        "doc_id", "own_key", "sheet_name", "cell_ref").withColumn("sheet_key", nfc(F.col("sheet_name")))
    cells = cells.withColumn("sheet_key", nfc(F.col("sheet_name")))
    sheets = cells.select("doc_id", "sheet_key").distinct().withColumn("known", F.lit(True))
    joined = (
        grouped.join(sheets, ["doc_id", "sheet_key"], "left")
        .join(cells.select("doc_id", "sheet_key", "cell_ref", "cell_type", "merged_top_left", "text"),
              ["doc_id", "sheet_key", "cell_ref"], "left")
        .withColumn("shown_label", F.coalesce(
            "location_label", F.concat(F.col("sheet_name"), F.lit(" 탭 "), F.col("cell_ref"), F.lit(" 셀"))))
    )
    value = F.coalesce("text", F.lit(""))
    where = F.col("shown_label")
    kind = F.coalesce("cell_type", F.lit("empty"))
    merged = F.coalesce(F.col("merged_top_left") != F.col("cell_ref"), F.lit(False))
    blank = (kind == "empty") | (value == "")
    note = (
        F.when(merged, warning(
            "merged_cell_not_top_left", where,
            F.lit(": 병합 셀의 좌상단 셀이 아니므로 자동 적용을 건너뛰었습니다. cellRef="), F.col("cell_ref")))
        .when(blank, warning("empty_cell", where, F.lit(": 빈 셀에 detection이 있어 자동 적용을 건너뛰었습니다.")))
        .when(kind == "formula", warning(
            "formula_cell", where,
            F.lit(": 수식 셀에 detection이 있어 자동 적용을 건너뛰었습니다. cellType=formula, formula="), value))
        .when(kind != "string", warning(
            "non_string_cell", where, F.lit(": 비문자열 셀에 detection이 있어 자동 적용을 건너뛰었습니다. cellType="),
            kind, F.lit(", cellValue="), value))
    )
    done = _applied_entry(joined.withColumn("note", note), "셀 값이", deletion_mode)
    own = lambda x: x["location_label"]
    no_sheet = _each_skipped(own, lambda x: warning("missing_sheet_name", _s(own(x)), F.lit(": sheetName이 없어 자동 적용을 건너뛰었습니다.")))
    no_cell = _each_skipped(own, lambda x: warning("missing_cell_ref", _s(own(x)), F.lit(": cellRef가 없어 자동 적용을 건너뛰었습니다.")))
    # The unknown-sheet item keeps the first target's own label and context.
    missing_sheet = _group_skipped(
        F.col("location_label"), F.coalesce(F.get("contexts", F.lit(0)), F.lit("")),
        warning("sheet_not_found", F.col("sheet_name"), F.lit(" 시트를 찾을 수 없어 자동 적용을 건너뛰었습니다.")))
    rejected = _group_skipped(where, F.when(merged | blank, "").otherwise(value), F.col("note"))
    return done.select("doc_id", F.inline(
        F.when(F.col("sheet_name") == "", no_sheet).when(F.col("cell_ref") == "", no_cell).when(F.col("known").isNull(), missing_sheet)
        .when(F.col("note").isNotNull(), rejected).otherwise(F.array("entry"))))


# Codes that also count as document-level warnings.
_GLOBAL = ("missing_sheet_name", "missing_cell_ref", "sheet_not_found", "missing_paragraph_no",
           "unsupported_docx_section", "missing_table_cell_location", "missing_slide_no",
           "unknown_section", "missing_shape_location", "missing_section_no", "missing_page_no")


def document_warnings(items: DataFrame) -> DataFrame:
    """Item warnings that are repeated on document level (doc_id, warning)."""
    code = F.regexp_extract("warning", r"^\[([a-z_]+)\]", 1)
    return items.select("doc_id", F.explode(rows_of(F.col("warnings"))).alias("warning")).where(code.isin(*_GLOBAL))


def unreadable_warnings(documents: DataFrame, units: DataFrame) -> DataFrame:
    """Document-level warnings of page documents: could not be opened, or opened without any text.

    ``documents``: doc_id, path, load_error (null when readable)."""
    counted = units.where(~is_blank(F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("n"))
    d = documents.join(counted, "doc_id", "left")
    note = (
        F.when(F.col("load_error").isNotNull(), warning(
            "pdf_encrypted", F.lit("PDF를 열 수 없습니다 (암호화 또는 손상 가능성). 파일: "), F.col("path"),
            F.lit(" / 원인: "), F.col("load_error")))
        .when(F.coalesce("n", F.lit(0)) == 0, warning(
            "scanned_pdf_no_text",
            F.lit("이 PDF는 텍스트를 추출할 수 없는 스캔 PDF일 가능성이 있습니다. 16주차 PoC에서는 OCR을 수행하지 않아 "
                  "자동 탐지가 불가능합니다. 파일: "), F.col("path")))
    )
    return d.select("doc_id", note.alias("warning")).where(F.col("warning").isNotNull())


def summarize(items: DataFrame, reviews: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """Per document: locations by status, warnings, automatic and review targets.

    The three inputs are reduced to counts per document before they meet."""
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(f"{status}_locations")

    a = items.groupBy("doc_id").agg(
        F.count("*").alias("total_locations"), n("applied"), n("partial"), n("skipped"),
        F.sum(F.size("warnings")).alias("total_warnings"),
        F.sum(F.col("applied_target_count") + F.col("skipped_target_count")).alias("auto_target_count"))
    r = reviews.groupBy("doc_id").agg(F.count("*").alias("review_target_count"))
    out = a.join(r, "doc_id", "full")
    if warnings is not None:
        w = warnings.groupBy("doc_id").agg(F.count("*").alias("document_warnings"))
        out = out.join(w, "doc_id", "full").withColumn(
            "total_warnings",
            F.coalesce("total_warnings", F.lit(0)) + F.coalesce("document_warnings", F.lit(0))
        ).drop("document_warnings")
    return out.na.fill(0)


def unit_summary(planned: DataFrame, deletion_mode: str = "delete") -> DataFrame:
    """:func:`summarize` for units carrying their own plan: one pass, one partial aggregation."""
    applied = F.when(
        F.size("auto_targets") > 0, apply_to_text(F.col("text"), F.col("auto_targets"), deletion_mode))
    parts = planned.select(
        "doc_id", F.size("review_targets").alias("rev"), F.size("auto_targets").alias("auto"),
        applied.alias("x"),
    ).select(
        "doc_id", "rev", "auto",
        F.when(F.col("x").isNotNull(), F.struct(
            F.size("x.applied").alias("a"), F.size("x.skipped").alias("s"),
            F.size("x.warnings").alias("w"))).alias("r"))
    status = F.when(F.col("r").isNotNull(), status_of(F.col("r.a"), F.col("r.s")))
    return parts.select("doc_id", "rev", "auto", "r", status.alias("status")).groupBy("doc_id").agg(
        F.count_if(F.col("auto") > 0).alias("total_locations"),
        F.count_if(F.col("status") == "applied").alias("applied_locations"),
        F.count_if(F.col("status") == "partial").alias("partial_locations"),
        F.count_if(F.col("status") == "skipped").alias("skipped_locations"),
        F.coalesce(F.sum("r.w"), F.lit(0)).alias("total_warnings"),
        F.sum("auto").cast("bigint").alias("auto_target_count"),
        F.sum("rev").cast("bigint").alias("review_target_count"),
    )
