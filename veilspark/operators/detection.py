"""Detection: pattern, name-recognition and classifier results as one array of detections per unit.

Pattern detection never leaves the row.  Name spans and classifier predictions arrive as tables keyed
by (doc_id, unit_no); they are filtered and grouped before they meet the units, so only the join
itself shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from veilspark.functions import hits as H
from veilspark.functions.location import location_key
from veilspark.functions.rules import IDENTIFIER_RULES, MASK, MINING_RULES, REVIEW, Rule
from veilspark.functions.text import built_once, cut, fixed, hangul_share, let, rows_of, strip

DETECTION = (
    "struct<ord:bigint,label:string,matched:string,grade:string,action:string,source:string,"
    "start:int,`end`:int,sensitive_type:string,sensitive_category:string,reason:string>"
)
DETECTIONS = f"array<{DETECTION}>"
UNIT_KEY = ["doc_id", "unit_no"]

# Entity labels that mean a person.
PERSON_LABELS = ("PERSON", "PER", "PS", "인명")
# Classifier classes and the grades they stand for.
CLASS_GRADES = {"개인정보": "S", "민감정보": "C", "일반": "O"}

NAME_LABEL = "성명"
NAME_TYPE = "개인정보"
CONTEXT_LABEL = "민감정보"
CONTEXT_TYPE = "문맥 기반 민감정보"
HOLD = "판단 보류"


# --- patterns -------------------------------------------------------------------------------------

def detect_patterns(
    units: DataFrame, rules: Sequence[Rule] = IDENTIFIER_RULES, text: str = "text"
) -> DataFrame:
    """One row per hit: the unit's other columns plus ``ord`` and the hit fields."""
    keep = [c for c in units.columns if c != text]
    return (
        units.where(H.may_hit(F.col(text), rules))
        .select(*keep, F.posexplode(H.pattern_hits(F.col(text), rules)).alias("ord", "hit"))
        .select(*keep, "ord", "hit.*")
    )


def detect_identifiers(
    units: DataFrame,
    base: Sequence[Rule] = IDENTIFIER_RULES,
    extra: Sequence[Rule] = MINING_RULES,
    check_base: bool = True,
    text: str = "text",
) -> DataFrame:
    """Like :func:`detect_patterns` with the mining rules added where no equal span exists."""
    keep = [c for c in units.columns if c != text]
    c = F.col(text)
    return (
        units.where(H.may_hit(c, [*base, *extra]))
        .select(*keep, F.posexplode(H.identifier_hits(c, base, extra, check_base)).alias("ord", "hit"))
        .select(*keep, "ord", "hit.*")
    )


def _numbered(arr: Column, offset: Column | None = None) -> Column:
    return F.transform(
        arr,
        lambda d, i: d.withField("ord", (i if offset is None else i + offset).cast("bigint")),
    )


def pattern_detections(text: Column, rules: Sequence[Rule], style: str = "document") -> Column:
    """Hits in the common detection shape.  ``style`` is ``document`` (reason from the rule) or
    ``cell`` (reason from the label).  Hits that lack label, value or span are dropped."""
    def shape(h: Column, i: Column) -> Column:
        by_label = F.concat(F.lit("정규식 탐지: "), h["label"])
        reason = by_label if style == "cell" else F.when(
            F.coalesce(h["desc"], F.lit("")) != "", h["desc"]).otherwise(by_label)
        return F.struct(
            i.cast("bigint").alias("ord"), h["label"].alias("label"), h["value"].alias("matched"),
            F.coalesce(h["grade"], F.lit("S")).alias("grade"),
            F.coalesce(h["action"], F.lit(MASK)).alias("action"), F.lit("regex").alias("source"),
            h["start"].alias("start"), h["end"].alias("end"),
            F.lit(None).cast("string").alias("sensitive_type"),
            h["label"].alias("sensitive_category"), reason.alias("reason"),
        )

    complete = F.filter(
        H.pattern_hits(text, rules),
        lambda h: h["label"].isNotNull() & h["value"].isNotNull()
        & h["start"].isNotNull() & h["end"].isNotNull(),
    )
    return let(complete, lambda hs: F.transform(hs, shape).cast(DETECTIONS))


def normalize_detector_output(found: DataFrame, units: DataFrame) -> DataFrame:
    """Bring detector tables with differing column names to one shape (label, matched, start, end,
    grade, action, sensitive_type, sensitive_category, reason).

    A ``span`` column (array of two) fills missing offsets, the unit text a missing match; rows
    still incomplete are dropped."""
    def pick(names: Sequence[str], default: Column | None = None) -> Column:
        have = [F.col(n) for n in names if n in found.columns]
        return F.coalesce(*have, *([] if default is None else [default]), F.lit(None))

    start = pick(["start", "startIndex", "begin"]).cast("int")
    end = pick(["end", "endIndex", "finish"]).cast("int")
    if "span" in found.columns:
        start = F.coalesce(start, F.get(F.col("span"), F.lit(0)).cast("int"))
        end = F.coalesce(end, F.get(F.col("span"), F.lit(1)).cast("int"))
    shaped = found.select(
        *UNIT_KEY,
        pick(["label", "name", "detectedLabel"]).cast("string").alias("label"),
        pick(["matched", "match", "value", "text", "detectedText"]).cast("string").alias("matched"),
        start.alias("start"),
        end.alias("end"),
        pick(["grade", "csoGrade", "cso_grade"], F.lit("S")).alias("grade"),
        pick(["action", "recommendedAction"], F.lit(MASK)).alias("action"),
        pick(["sensitive_type", "sensitiveType", "type"], F.lit("정규식 기반 탐지")).alias("sensitive_type"),
        pick(["sensitive_category", "sensitiveCategory", "category"]).alias("sensitive_category"),
        pick(["reason", "desc", "description"]).alias("reason"),
    )
    # Texts made by expressions look small to the optimiser; they are merged, never sent to the driver for a broadcast.
    texts = units.select(*UNIT_KEY, F.col("text").alias("unit_text")).hint("merge")
    with_text = shaped.join(texts, UNIT_KEY, "left")
    return (
        with_text.withColumn(
            "matched", F.coalesce("matched", cut(F.col("unit_text"), F.col("start"), F.col("end"))))
        .where("label is not null and matched is not null and start is not null and `end` is not null")
        .withColumn("sensitive_category", F.coalesce("sensitive_category", "label"))
        .withColumn("reason", F.when(F.coalesce("reason", F.lit("")) != "", F.col("reason")).otherwise(
            F.concat(F.lit("공통 regex_detector 탐지: "), F.col("label"))))
        .drop("unit_text")
    )


@built_once
def _text_detections(rules: tuple[Rule, ...], style: str) -> Column:
    return pattern_detections(F.col("text"), rules, style)


# --- person names ---------------------------------------------------------------------------------

def adapt_name_spans(outputs: DataFrame, source: str = "hf_ner") -> DataFrame:
    """Model output rows to person spans: one ``B-``/``I-`` prefix is removed, other labels, empty
    texts and rows without offsets are dropped, a missing score stays missing."""
    raw = F.coalesce("entity_group", "entity")
    label = F.regexp_replace(strip(raw), "^[BI]-", "")
    word = strip(F.coalesce("word", "text", F.lit("")))
    keys = [c for c in ("doc_id", "unit_no", "span_no") if c in outputs.columns]
    return outputs.where(
        label.isin(*PERSON_LABELS) & (word != "") & F.col("start").isNotNull() & F.col("end").isNotNull()
    ).select(
        *keys, F.lit("PERSON").alias("label"), word.alias("text"), F.col("start").cast("int"),
        F.col("end").cast("int"), F.lit(source).alias("source"),
        F.col("score").cast("double").alias("confidence"), raw.alias("original_label"),
    )


def name_detections(spans: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Person spans to detections; a missing confidence passes."""
    conf = F.col("confidence")
    keys = [c for c in ("doc_id", "unit_no", "span_no") if c in spans.columns]
    return spans.where((F.col("label") == "PERSON") & (conf.isNull() | (conf >= threshold))).select(
        *keys,
        F.lit(NAME_LABEL).alias("label"), F.col("text").alias("matched"), F.lit("S").alias("grade"),
        F.lit(MASK).alias("action"), F.lit("ner").alias("source"), "start", "end",
        F.lit(NAME_TYPE).alias("sensitive_type"), F.lit(NAME_LABEL).alias("sensitive_category"),
        F.concat(
            F.lit("NER 모델이 PERSON 개체로 탐지 / original_label="),
            F.coalesce("original_label", F.lit("None")), F.lit(" / confidence="),
            F.when(conf.isNull(), "없음").otherwise(fixed(conf, 4)),
            F.lit(f" / threshold={threshold:.2f}"),
        ).alias("reason"),
    )


def _entity_name() -> Column:
    """The group's name; a null or empty one gives way to the entity's own."""
    return F.coalesce(F.when(F.col("entity_group") != "", F.col("entity_group")), F.col("entity"), F.lit(""))


def inline_name_detections(
    outputs: DataFrame, text: Column, threshold: float = 0.8, style: str = "document"
) -> DataFrame:
    """Model output rows, already joined to their unit ``text``, to detections.

    ``style``: ``document`` needs offsets and more than two characters; ``cell`` treats missing
    offsets as 0; ``sheet`` needs offsets but no minimum length.  A missing score counts as 0."""
    raw = _entity_name()
    unprefixed = lambda c: F.replace(F.replace(c, F.lit("B-")), F.lit("I-"))
    entity = F.upper(unprefixed(raw)) if style == "sheet" else unprefixed(F.upper(raw))
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    start, end = F.col("start").cast("int"), F.col("end").cast("int")
    keep = entity.isin(*PERSON_LABELS) & (score >= threshold)
    if style == "cell":
        start, end = F.coalesce(start, F.lit(0)), F.coalesce(end, F.lit(0))
    else:
        keep = keep & start.isNotNull() & end.isNotNull()
    if style != "sheet":
        keep = keep & (end - start > 2)
    piece = cut(text, start, end)
    matched = piece if style == "cell" else F.coalesce(
        F.when(piece != "", piece), F.col("word"), F.lit(""))
    detail = F.concat(
        F.lit(" / original_label="), raw, F.lit(" / confidence="), fixed(score, 4),
        F.lit(f" / threshold={threshold:.2f}"))
    reason = {
        "document": F.concat(F.lit("NER 모델 PERSON 탐지"), detail),
        "sheet": F.concat(F.lit("NER 모델이 PERSON 개체로 탐지"), detail),
        "cell": F.lit("NER 탐지: PERSON"),
    }[style]
    keys = [c for c in ("doc_id", "unit_no", "span_no") if c in outputs.columns]
    return outputs.where(keep).select(
        *keys,
        F.lit(NAME_LABEL).alias("label"), matched.alias("matched"), F.lit("S").alias("grade"),
        F.lit(MASK).alias("action"), F.lit("ner").alias("source"), start.alias("start"),
        end.alias("end"), F.lit(NAME_TYPE).alias("sensitive_type"),
        F.lit(NAME_LABEL).alias("sensitive_category"), reason.alias("reason"),
    )


# --- sentence classifier --------------------------------------------------------------------------

def skips_classifier(
    text: Column, min_length: int = 10, min_share: float = 0.20, script: str = "[^가-힣]"
) -> Column:
    """True for units too short or with too little of the model's script (default Hangul)."""
    s = strip(text)
    share = hangul_share(s) if script == "[^가-힣]" else F.length(F.regexp_replace(s, script, "")) / F.length(s)
    return (F.length(s) < min_length) | (share < min_share)


def regroup_probabilities(
    predictions: DataFrame, probability: str = "probability", classes: Sequence[str] = tuple(CLASS_GRADES),
    class_grades: dict[str, str] = CLASS_GRADES,
) -> DataFrame:
    """Sum class probabilities (array column, in ``classes`` order) into p_c, p_s, p_o and pick the
    best grade, earlier grade first on ties."""
    probs = {
        g: sum((F.get(F.col(probability), F.lit(i)) for i, c in enumerate(classes)
                if class_grades.get(c) == g), F.lit(0.0))
        for g in ("C", "S", "O")
    }
    out = predictions.withColumns({f"p_{g.lower()}": p for g, p in probs.items()})
    return with_best_grade(out)


def with_best_grade(df: DataFrame) -> DataFrame:
    """Add ``grade`` and ``confidence`` from p_c, p_s, p_o."""
    best = F.greatest("p_c", "p_s", "p_o")
    return df.withColumns({
        "grade": F.when(F.col("p_c") == best, "C").when(F.col("p_s") == best, "S").otherwise("O"),
        "confidence": best,
    })


def hold_policy(
    predictions: DataFrame, text: str = "text", min_length: int = 5, threshold: float = 0.70
) -> DataFrame:
    """Final grade, or hold for short texts and for low confidence (then with a suggestion)."""
    n = F.length(strip(F.col(text)))
    conf = F.col("confidence")
    short, unsure = n < min_length, conf < threshold
    return predictions.select(
        *[c for c in predictions.columns if c not in ("grade", "confidence")],
        F.when(short | unsure, HOLD).otherwise(F.col("grade")).alias("pred_grade"),
        F.when(short, F.concat(F.lit("입력 문장이 너무 짧음: "), n.cast("string"), F.lit("자")))
        .when(unsure, F.concat(F.lit("모델 확신도 낮음: "), fixed(conf, 3)))
        .otherwise("정상 예측").alias("reason"),
        F.when(short, 0.0).otherwise(conf).alias("confidence"),
        F.when(~short & unsure, F.col("grade")).alias("suggested_grade"),
    )


def context_detections(predictions: DataFrame, threshold: float = 0.6, style: str = "document") -> DataFrame:
    """Predictions (grade, confidence, p_c, p_s, p_o) to review detections without a span."""
    digits, left, sep, right = {"document": (3, " / probs=(", ", ", ")"), "cell": (4, " / ", " / ", "")}[style]
    probs = F.concat(
        F.lit(f"{left}C="), fixed(F.col("p_c"), digits), F.lit(f"{sep}S="),
        fixed(F.col("p_s"), digits), F.lit(f"{sep}O="), fixed(F.col("p_o"), digits), F.lit(right))
    keys = [c for c in ("doc_id", "unit_no") if c in predictions.columns]
    return predictions.where((F.col("grade") != "O") & (F.col("confidence") >= threshold)).select(
        *keys,
        F.lit(CONTEXT_LABEL).alias("label"), F.lit("").alias("matched"), "grade",
        F.lit(REVIEW).alias("action"), F.lit("ai").alias("source"),
        F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"),
        F.lit(CONTEXT_TYPE).alias("sensitive_type"),
        F.concat(F.lit("AI_"), F.col("grade")).alias("sensitive_category"),
        F.concat(
            F.lit("AI 문장분류 grade="), F.col("grade"), F.lit(" / confidence="),
            fixed(F.col("confidence"), 4), F.lit(f" / threshold={threshold:.2f}"), probs,
        ).alias("reason"),
    )


# --- all together ---------------------------------------------------------------------------------

def _as_array(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Detections per unit as one array; a unit's detections are bounded by its text."""
    item = F.struct(
        F.lit(0).cast("bigint").alias("ord"), "label", "matched", "grade", "action", "source",
        "start", "end", "sensitive_type", "sensitive_category", "reason")
    return rows.groupBy(*UNIT_KEY).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(*order, item.alias("item")))), lambda x: x["item"]
        ).cast(DETECTIONS).alias("found"))


def detect_units(
    units: DataFrame,
    rules: Sequence[Rule] = IDENTIFIER_RULES,
    *,
    style: str = "document",
    names: DataFrame | None = None,
    predictions: DataFrame | None = None,
    name_threshold: float = 0.8,
    context_threshold: float | None = None,
    name_style: str | None = None,
) -> DataFrame:
    """Units plus ``detections``: patterns, then names, then the classifier's view of units that have
    no pattern hit and pass the script gate.

    ``names`` is a model output table, ``predictions`` a table with p_c, p_s, p_o (or grade and
    confidence); both keyed by (doc_id, unit_no).  Without both, the whole step stays inside the row.

    ``name_style`` chooses how names are read where it differs from ``style`` (``sheet``: names of any length).

    Units whose scorer failed get nothing from it and name it in ``failed`` (``ner``, ``ai``; only there where such a table
    is given).  A failure is a row with a text in a column ``error``, and for the classifier also a missing row of a unit that
    it should have scored.  ``scorer_failures`` counts them."""
    text = F.col("text")
    out = units.withColumn("detections", _text_detections(tuple(rules), style))
    failed: list[Column] = []
    if names is not None:
        spans = names.withColumnRenamed("text", "span_text") if "text" in names.columns else names
        if "error" in spans.columns:
            bad = spans.where(F.col("error").isNotNull()).select(*UNIT_KEY, F.lit(True).alias("_name_failed")).distinct()
            out = out.join(bad, UNIT_KEY, "left")
            failed.append(F.when(F.col("_name_failed"), "ner"))
            spans = spans.where(F.col("error").isNull()).drop("error")
        # Only candidate spans meet the unit text.
        person = F.upper(_entity_name()).rlike("PERSON|PER|PS|인명")
        order = ["span_no"] if "span_no" in spans.columns else ["start", "end"]
        near = spans.where(person).join(units.select(*UNIT_KEY, "text"), UNIT_KEY)
        found = inline_name_detections(near, text, name_threshold, name_style or ("cell" if style == "cell" else "document"))
        out = (
            out.join(_as_array(found, order).withColumnRenamed("found", "name_found"), UNIT_KEY, "left")
            .withColumn("detections", F.concat(
                "detections",
                _numbered(F.coalesce("name_found", F.array().cast(DETECTIONS)), F.size("detections"))))
            .drop("name_found")
        )
    if predictions is not None:
        tau = context_threshold if context_threshold is not None else (0.5 if style == "cell" else 0.6)
        well = predictions.where(F.col("error").isNull()).drop("error") if "error" in predictions.columns else predictions
        graded = well if "grade" in well.columns else with_best_grade(well)
        found = _as_array(context_detections(graded, tau, style), ["grade"])
        # One row for every scored unit, with or without a detection.
        scored = graded.select(*UNIT_KEY).distinct().join(found, UNIT_KEY, "left").select(
            *UNIT_KEY, F.col("found").alias("context_found"), F.lit(True).alias("_scored"))
        asked = ~F.exists("detections", lambda d: d["source"] == "regex") & ~skips_classifier(text)
        out = out.join(scored, UNIT_KEY, "left").withColumn("_asked", asked).withColumn("detections", F.when(
            F.col("context_found").isNotNull() & F.col("_asked"),
            F.concat("detections", _numbered(F.col("context_found"), F.size("detections"))),
        ).otherwise(F.col("detections"))).drop("context_found")
        failed.append(F.when(F.col("_asked") & F.col("_scored").isNull(), "ai"))
    if names is None and predictions is None:
        return out
    return out.withColumn("failed", F.filter(F.array(*failed), lambda f: f.isNotNull()) if failed else F.array().cast("array<string>")).drop(
        "_name_failed", "_scored", "_asked")


def scorer_failures(detected: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Per document: units, and those whose name or sentence scorer failed.  With an ``observation`` the totals (units,
    ner_failed, ai_failed) come from the same pass and are there once the result has been computed."""
    counts = [F.count(F.lit(1)).alias("units"), *(F.count_if(F.array_contains("failed", s)).alias(f"{s}_failed") for s in ("ner", "ai"))]
    seen = detected.observe(observation, *counts) if observation is not None else detected
    return seen.groupBy("doc_id").agg(*counts)


def classifier_input(units: DataFrame, rules: Sequence[Rule] = IDENTIFIER_RULES) -> DataFrame:
    """The units worth scoring: no pattern hit and past the script gate.  Put this filter before a
    Python scorer; Catalyst does not move predicates through one."""
    return units.where(~H.may_hit(F.col("text"), rules) & ~skips_classifier(F.col("text")))


def detection_rows(detected: DataFrame) -> DataFrame:
    """One row per detection with its unit's location, label and text as context."""
    return detected.select(
        *UNIT_KEY,
        F.col("text").alias("context"),
        *[c for c in ("location_label", "loc") if c in detected.columns],
        F.explode(rows_of(F.col("detections"))).alias("d"),
    ).select("*", "d.*").drop("d")


def with_location_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "loc_key", location_key(F.col("loc"), F.col("location_label"), F.col("context"),
                                F.concat_ws(".", F.col("unit_no").cast("string"), F.col("ord").cast("string"))))
