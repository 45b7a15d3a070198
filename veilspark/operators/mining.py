"""Mining a corpus for sentences worth labelling: noise rules, keyword roles, decision, priority.

Everything up to the candidate rows is a projection of the unit rows; the only shuffles are the
per-file counts and the final order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.hits import identifier_hits
from veilspark.functions.keywords import MATCH, KeywordPack, grouped_matches, normalized, role_matches
from veilspark.functions.rules import EARLY_MINING_RULES, IDENTIFIER_RULES, MINING_RULES
from veilspark.functions.running import ranked
from veilspark.functions.text import SPACE, SPACE_CLASS, let, strip
from veilspark.operators.units import TABLE_RULE, unit_id

CONTEXT_CANDIDATE = "ai_procedural_sensitive"
IDENTIFIER_CANDIDATE = "regex_identifier"

# Noise rules.
OPEN_CONTENT = re.sub(
    r"\\s", lambda _: SPACE,
    r"목\s*차|차\s*례|개정\s*이력|제\s*개정\s*이력|문서\s*목적|적용\s*범위|"
    r"용어\s*설명|용어의\s*정의|머리말|꼬리말|표\s*지",
)
REVISION_DATE = rf"개정{SPACE}*일{SPACE}*[:：]"
# The class keeps white space and drops backslashes and the letter s: that is how it is defined.
COMPACT_CLASS = r"[\\s|/·•ㆍ\-_:：,.;()\[\]]+"
HEADER_TERMS = (
    "구분", "항목", "내용", "비고", "설비명", "점검항목", "검사항목",
    "확인사항", "점검주기", "검사주기", "측정값", "판정기준",
)
EARLY_HEADER_TERMS = HEADER_TERMS[:8]
LABEL_STARTS = (
    "설비명", "검사항목", "점검주기", "관련기준", "검사방법", "참고사항",
    "점검항목", "확인사항", "판정기준", "검사주기",
)
PAGE_ONLY = r"(?iU)^\s*<!--\s*page\s+\d+\s*-->\s*$"
TITLE_ONLY = r"(?U)^[#\s\-*]*(?:[\w가-힣]+\s*){1,6}(?:매뉴얼|목록|현황|표준)[#\s\-*]*$"
DENSE_PIPES = r"(\|[^|]{0,20}){3,}"
SCHEDULE_PERIOD = r"(점검|검사)?주기|반기|분기|월간|연간|[0-9]+일|[0-9]+년"
SCHEDULE_TERMS = r"설비명|점검주기|검사주기|점검항목|검사항목"
PROCEDURE_TERMS = r"(?iu)수동|강제|절체|우회|BYPASS|비상|해제|명령|Script|설정"
SPARE_PARTS = r"^(확인)?해당역사예비품교체$"
REVISION_TERMS = rf"(?iu)Ver\.?{SPACE}*\p{{Nd}}|개정일|개정이력|목차|차례"
DOTTED_PAGE = rf"[.·]{{3,}}{SPACE}*\p{{Nd}}+{SPACE}*$"


def compact(c: Column) -> Column:
    """Text without separators, for the filters below."""
    return F.regexp_replace(c, COMPACT_CLASS, "")


def _term_count(text: Column, terms: tuple[str, ...]) -> Column:
    return sum((F.when(F.contains(text, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))


def is_table_rule(c: Column) -> Column:
    return strip(c).rlike(TABLE_RULE)


def is_table_header(c: Column) -> Column:
    """Short row naming at least two header terms."""
    k = compact(c)
    return (F.length(k) <= 80) & (_term_count(k, HEADER_TERMS) >= 2)


def is_early_table_header(c: Column) -> Column:
    k = F.regexp_replace(c, r"(?U)[|\s]", "")
    return (F.length(k) <= 60) & (_term_count(k, EARLY_HEADER_TERMS) >= 2)


def _schedule(k: Column) -> Column:
    return (
        (k.contains("설비명") & k.rlike(SCHEDULE_PERIOD))
        | ((F.length(k) <= 80) & k.rlike(SCHEDULE_TERMS) & ~k.rlike(PROCEDURE_TERMS))
        | k.rlike(SPARE_PARTS)
    )


def is_schedule(c: Column) -> Column:
    """Inspection periods, inventories, spare parts."""
    return let(compact(c), _schedule)


def is_contents_or_revision(c: Column) -> Column:
    return _contents_or_revision(strip(c), compact(c))


# Cheap tests before the rules with many alternatives: each of these has a Hangul syllable first, or is a version.
_HANGUL = "[가-힣]"


def _contents_or_revision(s: Column, k: Column) -> Column:
    return ((k.rlike(_HANGUL) | k.rlike("(?i)ver")) & k.rlike(REVISION_TERMS)) | (
        (s.contains("...") | s.contains("·")) & s.rlike(DOTTED_PAGE))


def _noise(s: Column, k: Column, heading_path: Column, current: bool) -> Column:
    """``s``: stripped text, ``k``: the same in compact form.  Cheap checks that decide most units come
    first; the rules are alternatives, so their order only shows in the reason."""
    out = F.when(s == "", "blank")
    if current:
        solid = s.rlike(rf"^(?:[^{SPACE_CLASS}]{SPACE}*+){{15}}")  # 15 characters beside white space
        spaces = F.length(s) - F.length(F.replace(s, F.lit(" ")))
        starts = F.lit(False)
        for label in LABEL_STARTS:
            starts = starts | s.startswith(label)
        out = (
            out.when(~solid, "too_short")
            .when(spaces / F.length(s) > 0.30, "scattered")
            .when(starts, "label_row")
        )
    out = out.when(s.startswith("<!--") & s.rlike(PAGE_ONLY), "page_comment").when(
        s.contains("---") & s.rlike(TABLE_RULE), "table_rule")
    if current:
        out = (
            out.when(s.contains("|") & (s.contains("| ---") | s.rlike(DENSE_PIPES)), "table_fragment")
            .when(_contents_or_revision(s, k), "contents_or_revision")
            .when(_schedule(k), "schedule")
        )
    headed = F.concat(heading_path, F.lit(" "), s)
    out = out.when(headed.rlike(_HANGUL) & headed.rlike(OPEN_CONTENT), "open_content")
    if current:
        out = out.when((F.length(k) <= 80) & (_term_count(k, HEADER_TERMS) >= 2), "table_header")
    else:
        out = out.when(is_early_table_header(s), "table_header").when(s.rlike(REVISION_DATE), "revision_date")
    # The title rule backtracks heavily, so its closing words are looked for first.
    title = (F.length(s) <= 40) & s.rlike("매뉴얼|목록|현황|표준") & s.rlike(TITLE_ONLY)
    return out.when(title, "title_only")


def noise_reason(text: Column, heading_path: Column, policy: str = "current") -> Column:
    """A noise rule the unit meets; null for units to keep.

    ``policy`` ``second`` leaves out the rules that came later (length, spacing, labels, pipes, the
    schedule rules and the wider revision rule)."""
    both = F.struct(strip(text).alias("s"), compact(strip(text)).alias("k"))
    return let(both, lambda b: _noise(b["s"], b["k"], heading_path, policy == "current"))


def is_noise(text: Column, heading_path: Column, policy: str = "current") -> Column:
    return noise_reason(text, heading_path, policy).isNotNull()


def _reasons(hits: Column) -> Column:
    return F.transform(hits, lambda h: F.struct(
        h["value"].alias("kw"), h["label"].alias("label"), F.lit("regex").alias("track"),
        h["rule"].alias("group"), F.lit(IDENTIFIER_CANDIDATE).alias("role")))


_REASON = "array<struct<kw:string,label:string,track:string,`group`:string,role:string>>"


def _as_reasons(matches: Column, with_role: bool = True) -> Column:
    return F.transform(matches, lambda m: F.struct(
        m["kw"].alias("kw"), F.lit(None).cast("string").alias("label"), m["track"].alias("track"),
        m["group"].alias("group"), (m["role"] if with_role else F.lit(None).cast("string")).alias("role"))
    ).cast(_REASON)


def decide(units: DataFrame, pack: KeywordPack, policy: str = "current") -> DataFrame:
    """Add matches, identifier hits and the decision columns to (non-noise) units.

    Policies: ``current``; ``second`` (ambiguous word plus anchor also makes a candidate, the
    suggestion ignores the band, no bands); ``first`` (C and S tracks only, see
    :func:`decide_first`)."""
    if policy == "first":
        return decide_first(units, pack)
    norm = F.col("_norm")
    out = units.withColumn("_norm", normalized(F.col("text")))
    roles = {"strong": "strong_procedural", "s_business": "s_business_sensitive",
             "ambiguous": "ambiguous_action", "anchors": "operational_anchor", "weak": "weak"}
    out = out.withColumns({
        **{n: role_matches(norm, pack, r) for n, r in roles.items()},
        "hits": identifier_hits(F.col("text"), IDENTIFIER_RULES, MINING_RULES),
    }).drop("_norm")
    n = {c: F.size(c) for c in (*roles, "hits")}
    paired = (n["ambiguous"] > 0) & (n["anchors"] > 0)
    context = (n["strong"] > 0) | (n["s_business"] > 0)
    if policy == "second":
        context = context | paired
    identified = n["hits"] > 0
    score = F.round(
        3.0 * n["strong"] + 2.0 * n["s_business"]
        + F.when(paired, 2.0 * F.least(n["ambiguous"], n["anchors"])).otherwise(0.0)
        + (F.when(context & (n["weak"] > 0), 0.2 * F.least(n["weak"], F.lit(3))).otherwise(0.0)), 2)
    empty = F.array().cast(_REASON)
    grade = F.when((n["strong"] > 0) | paired, "C").when(n["s_business"] > 0, "S").otherwise("")
    out = out.withColumns({
        "candidate_type": F.filter(F.array(
            F.when(context, CONTEXT_CANDIDATE), F.when(identified, IDENTIFIER_CANDIDATE)), lambda t: t.isNotNull()),
        "candidate_reason": F.concat(
            _as_reasons(F.col("strong")), _as_reasons(F.col("s_business")),
            F.when(paired, F.concat(_as_reasons(F.col("ambiguous")), _as_reasons(F.col("anchors")))).otherwise(empty),
            F.when(context, _as_reasons(F.col("weak"))).otherwise(empty),
            _reasons(F.col("hits")).cast(_REASON)),
        "regex_only": identified & ~context,
        "priority_score": score,
        "strong_count": n["strong"] + n["s_business"],
        "ambiguous_count": n["ambiguous"], "anchor_count": n["anchors"], "weak_count": n["weak"],
        "regex_count": n["hits"],
        "_grade": grade,
    })
    band = F.when(F.col("priority_score") >= 6, "high").when(F.col("priority_score") >= 3, "medium").otherwise("low")
    if policy == "second":
        out = out.withColumns({"priority_band": F.lit(None).cast("string"), "suggested_grade": F.col("_grade")})
    else:
        out = out.withColumn("priority_band", band).withColumn(
            "suggested_grade", F.when(F.col("priority_band") != "low", F.col("_grade")).otherwise(""))
    return out.drop("_grade", *roles, "hits")


def decide_first(units: DataFrame, pack: KeywordPack) -> DataFrame:
    """First policy: any C or S keyword makes a candidate; an identifier alone counts as such only
    when not even a weak keyword is near."""
    strong, weak = grouped_matches(F.col("_norm"), pack)
    out = units.withColumn("_norm", normalized(F.col("text"))).withColumns({
        "strong": strong, "weak": weak,
        "hits": identifier_hits(F.col("text"), IDENTIFIER_RULES, EARLY_MINING_RULES, check_base=False),
    }).drop("_norm")
    has_s, has_w, has_h = F.size("strong") > 0, F.size("weak") > 0, F.size("hits") > 0
    empty = F.array().cast(_REASON)
    return out.withColumns({
        "candidate_type": F.filter(F.array(
            F.when(has_s, CONTEXT_CANDIDATE), F.when(has_h, IDENTIFIER_CANDIDATE)), lambda t: t.isNotNull()),
        "candidate_reason": F.concat(
            _as_reasons(F.col("strong"), False),
            F.when(has_s, _as_reasons(F.col("weak"), False)).otherwise(empty),
            F.transform(_reasons(F.col("hits")).cast(_REASON), lambda r: r.withField("role", F.lit(None).cast("string")))),
        "regex_only": has_h & ~has_s & ~has_w,
        "suggested_grade": F.lit(""),
    }).drop("strong", "weak", "hits")


def mine(units: DataFrame, pack: KeywordPack, policy: str = "current") -> DataFrame:
    """All units with ``noise_reason`` and the decision columns (null for noise).

    One pass serves both the candidate rows and the counts; the array work runs on kept units only
    because noise units get a null text for it."""
    marked = units.withColumn(
        "noise_reason",
        F.lit(None).cast("string") if policy == "first" else noise_reason(
            F.col("text"), F.col("heading_path"), policy))
    kept = marked.withColumn("_text", F.col("text")).withColumn(
        "text", F.when(F.col("noise_reason").isNull(), F.col("text")))
    return decide(kept, pack, policy).withColumn("text", F.col("_text")).drop("_text")


def candidates(units: DataFrame, pack: KeywordPack, policy: str = "current", source: str = "source_file") -> DataFrame:
    """Candidate rows with all output columns, unordered."""
    keep = units if policy == "first" else units.where(
        ~is_noise(F.col("text"), F.col("heading_path"), policy))
    d = decide(keep, pack, policy).where(F.size("candidate_type") > 0)
    name = F.col(source).cast("string")
    cols = {
        "sourceFile": name,
        "unitId": unit_id(name, F.col("heading_path"), F.col("text")),
        "text": F.col("text"), "headingPath": F.col("heading_path"), "precedingText": F.col("preceding_text"),
        "candidateType": F.to_json("candidate_type"), "candidateReason": F.to_json("candidate_reason"),
        "regexOnly": F.col("regex_only").cast("string"), "suggestedGrade": F.col("suggested_grade"),
    }
    if policy != "first":
        cols["priorityScore"] = F.col("priority_score")
        if policy == "current":
            cols["priorityBand"] = F.col("priority_band")
        cols |= {
            "strongKeywordCount": F.col("strong_count"), "ambiguousActionCount": F.col("ambiguous_count"),
            "anchorKeywordCount": F.col("anchor_count"), "weakKeywordCount": F.col("weak_count"),
            "regexIdentifierCount": F.col("regex_count"), "noiseFlag": F.lit("false"),
        }
    cols |= {"userGrade": F.lit(""), "memo": F.lit("")}
    return d.select(*[c.alias(n) for n, c in cols.items()], "unit_no")


def in_review_order(rows: DataFrame) -> DataFrame:
    """Priority, then strong keywords, then file and unit order.  Sorting is the last step before a sink."""
    return rows.orderBy(F.desc("priorityScore"), F.desc("strongKeywordCount"), "sourceFile", "unit_no")


def with_review_rank(rows: DataFrame) -> DataFrame:
    """The same order as a column ``reviewRank`` (from 1), for tables that are not written in one piece."""
    return ranked(rows, [-F.col("priorityScore"), -F.col("strongKeywordCount"), F.col("sourceFile"), F.col("unit_no")], "reviewRank")


def context_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("candidateType").contains(CONTEXT_CANDIDATE))


def identifier_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("candidateType").contains(IDENTIFIER_CANDIDATE))


def mining_counts(units: DataFrame, pack: KeywordPack, policy: str = "current", source: str = "source_file") -> DataFrame:
    """Units, noise, context and identifier candidates per file, with a total row (null file)."""
    m = mine(units, pack, policy)
    per_file = m.groupBy(F.col(source).cast("string").alias("sourceFile")).agg(
        F.count("*").alias("units"),
        F.count("noise_reason").alias("noise"),
        F.count_if(F.array_contains("candidate_type", CONTEXT_CANDIDATE)).alias("ai"),
        F.count_if(F.array_contains("candidate_type", IDENTIFIER_CANDIDATE)).alias("regex"),
        F.count_if("regex_only").alias("regexOnly"))
    # The rollup runs over one row per file, not over the units.
    names = ("units", "noise", "ai", "regex", "regexOnly")
    return per_file.rollup("sourceFile").agg(*[F.sum(n).alias(n) for n in names])


def cutoff_score(rows: DataFrame, n: int = 400) -> DataFrame:
    """Lowest priority among the first ``n`` context candidates."""
    top = context_rows(rows).orderBy(F.desc("priorityScore")).limit(n)
    return top.agg(F.min("priorityScore").alias("min_priority"), F.count("*").alias("rows"))
