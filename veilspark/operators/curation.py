"""Cleaning texts for training, validating labelled rows, regrading and merging labelled sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.grades import GRADES
from veilspark.functions.text import QUICK_SPACE, nfc, strip

CORRUPTED = "[CORRUPTED_EXCEL_FORMULA]"
# Spreadsheet errors, bullets, category sets and keywords.
SHEET_ERRORS = ("#NAME?", "#REF!", "#VALUE!", "#DIV/0!", "#N/A")
BULLETS = "◯○●◦▪▫■□◆◇★☆※·∙•‣⁃◈◐◑"
FLAG_COLUMNS = (
    "has_personal", "has_sensitive_legal", "has_sensitive_business",
    "is_direct_sensitive_text", "is_document_sensitive_signal",
)
REQUIRED_COLUMNS = (
    "id", "text", "has_personal", "has_sensitive_legal", "has_sensitive_business",
    "sensitive_category", "cso_grade", "deidentify_method", "is_direct_sensitive_text",
    "is_document_sensitive_signal", "indicated_sensitive_category", "note",
)
PERSONAL_CATEGORIES = ("성명", "연락처", "이메일", "사번", "성명/연락처")
NOT_APPLICABLE = "해당 없음"
OPEN_CATEGORIES = ("일반업무", "분류설명")
LEGAL_CATEGORIES = ("건강정보", "복지정보")
SECURITY_CATEGORY = "보안정보"
SECURITY_WORDS = (
    "내부망", "서버 IP", "서버IP", "방화벽 정책", "방화벽", "취약점", "접근 권한", "접근권한",
    "계정", "비밀번호", "인증", "침해 탐지", "침해탐지",
)
SENSITIVE_CATEGORIES = (
    "계약정보", "예산/원가정보", "계획/전략정보", "감사/법무정보", "입찰평가", "입찰정보", "인사정보",
    "인사/조직정보", "운영/유지보수정보", "장애/사고대응", "운용데이터", "단속/민원정보",
    "민원처리정보", "보안운영정보",
)
MERGED_COLUMNS = (
    "text", "label", "augmented", "source", "sourceFile", "originalGrade", "hasPersonal",
    "hasSensitiveLegal", "hasSensitiveBusiness", "sensitiveCategory", "remapReason", "memo",
)


# --- cleaning -----------------------------------------------------------------------------------------

def strip_bullets(c: Column) -> Column:
    """Enclosed alphanumerics, the bullets' private-use area and bullet signs become spaces."""
    return F.regexp_replace(
        c, rf"[\x{{b7}}\x{{2000}}-\x{{26ff}}\x{{f000}}-\x{{f0ff}}&&[\x{{2460}}-\x{{24ff}}\x{{f000}}-\x{{f0ff}}{BULLETS}]]", " ")


def keep_inner_slashes(c: Column) -> Column:
    """A slash stays only between letters or digits on both sides."""
    side = "[A-Za-z0-9가-힣]"
    return F.regexp_replace(c, rf"/(?:(?<!{side}/)|(?!{side}))", " ")


def tidy_spacing(c: Column) -> Column:
    """White space becomes single spaces first: all that follows are plain replacements."""
    c = F.regexp_replace(c, f"{QUICK_SPACE}+", " ")
    for old, new in (("( ", "("), (" )", ")"), ("()", "")):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.trim(F.regexp_replace(c, "  +", " "))
    for end in ".,)":
        c = F.replace(c, F.lit(f" {end}"), F.lit(end))
    return c


def clean_text(c: Column, normalize: bool = True) -> Column:
    """Text for training: error markers, NFC, bullets, slashes, spacing; null becomes ''.

    ``normalize=False`` leaves NFC out where the input is known to be normalised, which keeps the
    whole expression in the JVM."""
    text = nfc(c) if normalize else c
    return (
        F.when(c.isNull(), "")
        .when(strip(c).isin(*SHEET_ERRORS), CORRUPTED)
        .otherwise(tidy_spacing(keep_inner_slashes(strip_bullets(text))))
    )


def clean_dataset(df: DataFrame, column: str = "text", normalize: bool = True) -> DataFrame:
    """Clean a column, keep the original as ``text_raw``."""
    raw = F.col(column)
    return df.withColumn("text_raw", raw).withColumn(column, clean_text(F.col("text_raw"), normalize))


def cleaning_counts(cleaned: DataFrame, column: str = "text") -> DataFrame:
    return cleaned.agg(
        F.count("*").alias("rows"),
        F.count_if(~F.col(column).eqNullSafe(F.col("text_raw"))).alias("changed"),
        F.count_if(F.col(column) == CORRUPTED).alias("corrupted"))


# --- validation ----------------------------------------------------------------------------------------

def label_issues(rows: DataFrame) -> DataFrame:
    """One row (id, rule, message, text) per violated label rule.  Missing columns are reported as
    ``COLUMN`` issues, and then only the rules whose columns exist are checked."""
    have = set(rows.columns)

    def issue(rule: str, *message: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.concat(*message).alias("message"))

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    c = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in REQUIRED_COLUMNS if n in have}
    checks: list[tuple[tuple[str, ...], str, object, tuple]] = []
    for f in FLAG_COLUMNS:
        checks.append(((f,), "R1", lambda f=f: ~c[f].isin("Y", "N"),
                       lambda f=f: (F.lit(f"{f} 값은 Y 또는 N이어야 합니다: "), shown(f))))
    checks += [
        (("cso_grade",), "R2", lambda: ~c["cso_grade"].isin(*GRADES),
         lambda: (F.lit("cso_grade 값은 C/S/O 중 하나여야 합니다: "), shown("cso_grade"))),
        (("is_direct_sensitive_text", "deidentify_method"), "R3",
         lambda: (c["is_direct_sensitive_text"] == "Y") & (c["deidentify_method"] == NOT_APPLICABLE),
         lambda: (F.lit("is_direct_sensitive_text=Y이면 deidentify_method는 '해당 없음'이면 안 됩니다."),)),
        (("is_direct_sensitive_text", "deidentify_method"), "R4",
         lambda: (c["is_direct_sensitive_text"] == "N") & (c["deidentify_method"] != NOT_APPLICABLE),
         lambda: (F.lit("is_direct_sensitive_text=N이면 deidentify_method는 '해당 없음'이어야 합니다."),)),
        (("is_document_sensitive_signal", "indicated_sensitive_category"), "R5",
         lambda: (c["is_document_sensitive_signal"] == "Y") & (c["indicated_sensitive_category"] == NOT_APPLICABLE),
         lambda: (F.lit("is_document_sensitive_signal=Y이면 indicated_sensitive_category가 구체적으로 부여되어야 합니다."),)),
        (("is_document_sensitive_signal", "indicated_sensitive_category"), "R6",
         lambda: (c["is_document_sensitive_signal"] == "N") & (c["indicated_sensitive_category"] != NOT_APPLICABLE),
         lambda: (F.lit("is_document_sensitive_signal=N이면 indicated_sensitive_category는 '해당 없음'이어야 합니다."),)),
        (("has_personal", "has_sensitive_legal", "has_sensitive_business", "cso_grade"), "R7",
         lambda: ((c["has_personal"] == "Y") | (c["has_sensitive_legal"] == "Y") | (c["has_sensitive_business"] == "Y"))
         & (c["cso_grade"] == "O"),
         lambda: (F.lit("has_* 플래그 중 하나라도 Y이면 cso_grade는 O이면 안 됩니다."),)),
        (("cso_grade", "is_direct_sensitive_text"), "R8",
         lambda: (c["cso_grade"] == "O") & (c["is_direct_sensitive_text"] == "Y"),
         lambda: (F.lit("cso_grade=O이면 is_direct_sensitive_text는 N이어야 합니다."),)),
        (("has_personal", "has_sensitive_legal", "has_sensitive_business", "sensitive_category"), "R9",
         lambda: (c["has_personal"] == "Y") & (c["has_sensitive_legal"] == "N")
         & (c["has_sensitive_business"] == "N") & ~c["sensitive_category"].isin(*PERSONAL_CATEGORIES),
         lambda: (F.lit("has_personal=Y 단독 문장은 sensitive_category가 개인정보 계열이어야 합니다."),)),
    ]
    found = [F.when(cond(), issue(rule, *msg())) for need, rule, cond, msg in checks if have.issuperset(need)]
    out = rows.select(
        c.get("id", F.lit("")).alias("id"), c.get("text", F.lit("")).alias("text"),
        F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())),
    ).select("id", "rule", "message", "text")
    lacking = [x for x in REQUIRED_COLUMNS if x not in have]
    # The empty-file issue is decided by a global aggregate, so it needs no second action.
    empty = rows.agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit("").alias("id"), F.lit("FILE").alias("rule"), F.lit("데이터가 비어 있습니다.").alias("message"),
        F.lit("").alias("text"))
    if lacking:
        columns = rows.agg(F.count("*").alias("n")).where("n > 0").select(F.explode(
            F.array(*[F.lit(x) for x in lacking])).alias("c")).select(
            F.lit("").alias("id"), F.lit("COLUMN").alias("rule"),
            F.concat(F.lit("필수 컬럼 누락: "), F.col("c")).alias("message"), F.lit("").alias("text"))
        out = out.unionByName(columns)
    return out.unionByName(empty)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per value of several columns (column, value, n) in one pass."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column (column, nulls)."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])).alias("x")).select("x.*")


def text_lengths(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("text_length", F.length(column))


# --- regrading and merging --------------------------------------------------------------------------------

def regrade(rows: DataFrame) -> DataFrame:
    """Add ``original_grade``, ``label`` and ``remap_reason``; the first rule that applies decides."""
    cat = strip(F.col("sensitive_category"))
    orig = F.upper(strip(F.col("cso_grade")))
    legal, personal, business = (F.col(c) == "Y" for c in (
        "has_sensitive_legal", "has_personal", "has_sensitive_business"))
    words = F.filter(F.array(*[F.lit(w) for w in SECURITY_WORDS]), lambda w: F.contains(F.col("text"), w))
    secure = cat == SECURITY_CATEGORY
    has_word = F.size("_words") > 0

    def case(*results: Column) -> Column:
        r = list(results)
        return (
            F.when(cat.isin(*OPEN_CATEGORIES), r[0])
            .when(~legal & ~personal & ~business, r[1])
            .when(legal, r[2])
            .when(cat.isin(*LEGAL_CATEGORIES), r[3])
            .when(secure & has_word, r[4])
            .when(secure, r[5])
            .when(cat.isin(*SENSITIVE_CATEGORIES), r[6])
            .otherwise(r[7])
        )

    lit = F.lit
    return rows.withColumn("_words", F.when(secure, words)).withColumns({
        "original_grade": orig,
        "label": case(lit("O"), lit("O"), lit("C"), lit("C"), lit("C"), lit("S"), lit("S"), orig),
        "remap_reason": case(
            F.concat(lit("O유지: 카테고리="), cat),
            lit("O자동: 민감 플래그 모두 N"),
            F.concat(lit("C유지: has_sensitive_legal=Y (cat="), cat, lit(")")),
            F.concat(lit("C유지: 법령상 민감정보 (cat="), cat, lit(")")),
            F.concat(lit("C유지: 보안정보+키워드("), F.array_join(F.slice("_words", 1, 3), ", "), lit(")")),
            lit("S재분류: 보안정보(공격악용키워드없음)"),
            F.concat(lit("S재분류: "), cat, F.when(orig != "S", F.concat(lit("(기존="), orig, lit(")"))).otherwise("")),
            F.concat(lit("원본유지: (cat="), cat, lit(")")),
        ),
    }).drop("_words")


def merged_training_set(labelled: DataFrame, reviewed: DataFrame, source_file: str = "privacy_sentence_sample_v5.csv") -> DataFrame:
    """Regraded labelled rows followed by reviewed candidates with a valid grade, common columns."""
    r = regrade(labelled)
    first = r.select(
        "text", "label", F.lit("0").alias("augmented"), F.lit("privacy_v5").alias("source"),
        F.lit(source_file).alias("sourceFile"), F.col("original_grade").alias("originalGrade"),
        F.col("has_personal").alias("hasPersonal"), F.col("has_sensitive_legal").alias("hasSensitiveLegal"),
        F.col("has_sensitive_business").alias("hasSensitiveBusiness"),
        F.col("sensitive_category").alias("sensitiveCategory"), F.col("remap_reason").alias("remapReason"),
        (F.col("note") if "note" in labelled.columns else F.lit("")).alias("memo"))

    def opt(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in reviewed.columns else F.lit(default)

    grade = F.upper(strip(F.coalesce("userGrade", F.lit(""))))
    second = reviewed.where(grade.isin(*GRADES)).select(
        "text", grade.alias("label"), opt("augmented", "0").alias("augmented"), F.lit("trainset").alias("source"),
        opt("sourceFile", "").alias("sourceFile"), grade.alias("originalGrade"),
        *[F.lit("").alias(n) for n in ("hasPersonal", "hasSensitiveLegal", "hasSensitiveBusiness", "sensitiveCategory")],
        F.lit("trainset_label").alias("remapReason"), opt("memo", "").alias("memo"))
    return first.unionByName(second)


def regrade_audit(regraded: DataFrame) -> DataFrame:
    """Transitions original grade -> label with counts and share."""
    g = regraded.groupBy("original_grade", "label").agg(F.count("*").alias("n"))
    # At most a handful of rows are left here.
    return g.withColumns({
        "changed": F.col("original_grade") != F.col("label"),
        "share": F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(0))), 1),
    })


def changed_sample(regraded: DataFrame, order: str, n: int = 20) -> DataFrame:
    """First changed rows in input order."""
    return regraded.where(F.col("original_grade") != F.col("label")).orderBy(order).limit(n)


def failed_expectations(rows: DataFrame, expected: Mapping[str, str], order: str | None = None) -> DataFrame:
    """Expected labels by text that the rows do not have; of rows with the same text the last counts: by ``order`` where it
    is given, else as the rows are read."""
    spark = rows.sparkSession
    want = spark.createDataFrame(list(expected.items()), "text string, expected string")
    known = rows.withColumn("_at", F.col(order) if order else F.monotonically_increasing_id()).where(F.col("text").isin(*expected))
    have = known.groupBy("text").agg(F.max_by("label", "_at").alias("actual"))
    return want.join(have, "text", "left").where(~F.col("expected").eqNullSafe(F.col("actual")))


def append_rows(existing: DataFrame, new: DataFrame, order: str, id_column: str = "id") -> DataFrame:
    """Existing rows plus new ones whose ids continue after the highest.

    New rows are numbered over runs of their order column, not in one task."""
    from veilspark.functions.running import numbered

    # The highest id is one row, whatever the size of the existing set.
    top = existing.agg(F.max(F.col(id_column).cast("bigint")).alias("_top")).withColumn("_all", F.lit(0))
    n = numbered(new.withColumn("_all", F.lit(0)), ["_all"], order, "_n", kind="bigint").join(F.broadcast(top), "_all")
    ids = F.col("_n") + 1 + F.coalesce("_top", F.lit(0))
    cast = existing.schema[id_column].dataType
    return existing.unionByName(
        n.withColumn(id_column, ids.cast(cast)).select(*existing.columns), allowMissingColumns=False)
