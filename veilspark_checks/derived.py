"""Inputs derived from the driver tables.

The expressions below are plain SQL that both engines read, so that both sides start from the same
identifier-shaped texts.  The documents themselves hold few identifiers, hence the texts built from keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources.tables import spread

_K = "c_custkey"


def _pad(expr: str, n: int) -> str:
    return f"lpad(cast({expr} as string), {n}, '0')"


def _num(expr: str) -> str:
    return f"cast({expr} as string)"


# One identifier of every rule per customer, some of them overlapping.
CONTACT_TEXT = "concat(" + ", ".join([
    "'고객 '", "c_name", "' 주민번호 '", _pad(f"{_K} % 1000000", 6), "'-'", _num(f"1000000 + {_K} % 9000000"),
    "'이며 여권 M'", _pad(f"({_K} * 7919) % 100000000", 8), "'이고 서버 10.'", _num(f"{_K} % 256"), "'.'",
    _num("c_nationkey"), "'.'", _num(f"{_K} % 200"), "' 외부 8.8.'", _num("c_nationkey"), "'.'", _num(f"{_K} % 99"),
    "' 전화 010-'", _pad(f"{_K} % 10000", 4), "'-'", _pad(f"({_K} * 31) % 10000", 4), "'이고 02'",
    _pad(f"{_K} % 100000000", 8), "' 메일 User.'", _num(_K), "'@mail'", _num("c_nationkey"),
    "'.Example.com입니다 사번 ab'", _pad(f"{_K} % 1000000", 6), "' 계좌 110-'", _pad(f"{_K} % 1000", 3), "'-'",
    _pad(f"({_K} * 17) % 1000000", 6), "' 및 123-45-'", _pad(f"{_K} % 1000000", 6), "' 주파수 75.'",
    _pad(f"{_K} % 1000", 3), "' mhz 위치 37k'", _pad(f"{_K} % 1000", 3), "' 시각 '", _pad(f"{_K} % 24", 2), "':'",
    _pad(f"{_K} % 60", 2), "':'", _pad(f"({_K} * 7) % 60", 2), "' 카드 1234-5678-'", _pad(f"{_K} % 10000", 4),
    "'-'", _pad(f"({_K} * 3) % 10000", 4), "' 면허 11-22-'", _pad(f"{_K} % 1000000", 6), "'-33 VLAN '",
    _num(f"{_K} % 4096"), "', Port '", _num(f"1000 + {_K} % 9000"), "' 대표 1588-'", _pad(f"{_K} % 10000", 4),
    "' 지점 032) '", _pad(f"{_K} % 1000", 3), "'-'", _pad(f"{_K} % 10000", 4), "' 마스킹 20*.23*.9*.71 ID: u'",
    _num(_K), "'x password=pw'", _num(f"{_K} % 77"), "'! 끝'",
]) + ")"

# Shorter contact notes with one or two identifiers, for guides and sheets.
NOTE_TEXT = (
    f"concat('담당 ', c_mktsegment, ' 연락처 010-', {_pad(f'{_K} % 10000', 4)}, '-', {_pad(f'({_K} * 13) % 10000', 4)}, "
    f"case when {_K} % 3 = 0 then concat(' 서버 192.168.', {_num('c_nationkey')}, '.', {_num(f'{_K} % 250')}) else ' 회신 바람' end)"
)

# Manual-like lines per part, a handful of shapes that meet the noise rules and the keyword roles.
MANUAL_LINE = (
    "case p_partkey % 20 "
    "when 0 then concat('목 차 ', p_name, ' 안내 자료 모음') "
    "when 1 then concat('설비명 ', p_name, ' 점검주기 반기 1회 시행') "
    "when 2 then concat('검사항목 ', p_type, ' 확인 바람') "
    "when 3 then concat('| ', p_name, ' | ', p_brand, ' | ', p_type, ' |') "
    "when 4 then '|---|:---:|' "
    "when 5 then concat('| 구분 | 항목 | ', p_name, ' |') "
    "when 6 then concat('## ', p_name) "
    "when 7 then concat('### ', p_brand) "
    "when 8 then concat('**', p_type, '** :') "
    "when 9 then concat('<!-- page ', cast(p_partkey as string), ' -->') "
    "when 10 then concat('장애 발생 시 카드 리셋 후 ', p_name, ' 장비의 복구 절차를 따른다 서버 10.1.2.', cast(p_size as string)) "
    "when 11 then concat('차단기 원격 투입 순서와 전원 투입 순서를 ', p_name, ' 기준으로 확인한다') "
    "when 12 then concat(p_name, ' 납품 단가와 계약 금액은 내부 보고 자료로만 관리한다') "
    "when 13 then concat('문의 전화 031-555-', lpad(cast(p_partkey % 10000 as string), 4, '0'), ' 로 연락 바랍니다 ', p_name) "
    "when 14 then concat('서버 장애 복구 상태를 확인하고 ', p_name, ' 회선을 점검한다') "
    "when 15 then concat('전면 표시 상태 확인 ', p_name, ' 정상 동작 여부를 점검한다') "
    "when 16 then concat('설 비 명 주 제 어 장 치 ', p_name) "
    "when 17 then p_name "
    "when 18 then concat('ID: admin', cast(p_partkey as string), ' password=pw', cast(p_size as string), ' 임시 계정 ', p_name) "
    "else concat('Ver. ', cast(p_size as string), ' 개정일 ', p_name) end"
)

# Labelled rows in the twelve-column layout, from labels and documents.
LABELLED_COLUMNS = {
    "id": "cast(l.doc_id as string)",
    "text": "concat(case l.doc_id % 9 when 0 then '방화벽 정책 서버 IP 계정 ' when 1 then '비밀번호 변경 ' else '' end, d.lang, ' ', d.source)",
    "has_personal": "case when l.quality = 1 and l.doc_id % 4 = 0 then 'Y' when l.doc_id % 41 = 0 then 'y' else 'N' end",
    "has_sensitive_legal": "case when l.toxic = 1 and l.doc_id % 3 = 0 then 'Y' else 'N' end",
    "has_sensitive_business": "case when l.doc_id % 5 < 2 then 'Y' else 'N' end",
    "sensitive_category": "case l.doc_id % 8 when 0 then '보안정보' when 1 then '계약정보' when 2 then '건강정보' when 3 then '일반업무' "
                          "when 4 then '성명' when 5 then '장애/사고대응' when 6 then '기타' else '운용데이터' end",
    "cso_grade": "case when l.toxic = 1 then 'C' when l.quality = 0 then 'S' when l.doc_id % 37 = 0 then 'Z' else 'O' end",
    "deidentify_method": "case when l.doc_id % 7 < 3 then '해당 없음' else '마스킹' end",
    "is_direct_sensitive_text": "case when l.doc_id % 6 < 3 then 'Y' else 'N' end",
    "is_document_sensitive_signal": "case when l.doc_id % 10 < 5 then 'Y' else 'N' end",
    "indicated_sensitive_category": "case when l.doc_id % 3 = 0 then '해당 없음' else '계약정보' end",
    "note": "d.lang",
}

# Feedback from labels and documents.
FEEDBACK_COLUMNS = {
    "locationLabel": "concat(cast(1 + l.doc_id % 7 as string), '쪽 ', cast(1 + l.doc_id % 40 as string), '번째 줄')",
    "context": "case when l.doc_id % 29 = 0 then '  ' else concat(' ', d.lang, ' ', d.source, ' ', cast(d.n_chars as string), ' ') end",
    "aiGrade": "case when l.doc_id % 23 = 0 then null when l.toxic = 1 then 'C' when l.quality = 0 then 'S' else 'O' end",
    "userGrade": "case l.doc_id % 5 when 0 then 'X' when 1 then 'S' when 2 then 'C' else 'O' end",
    "fileType": "case l.doc_id % 6 when 0 then null when 1 then 'pdf' when 2 then 'docx' when 3 then 'hwpx' when 4 then 'pptx' else 'xlsx' end",
    "feedback_date": "concat('2026-05-', lpad(cast(1 + l.doc_id % 28 as string), 2, '0'))",
    "timestamp": "cast(l.doc_id as double)",
}


# Row keys of the tables whose texts are worked on.
_SPREAD = {"documents": "doc_id", "customer": "c_custkey", "part": "p_partkey", "conversations": "conv_id", "benchmark": "item_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, _SPREAD[name]) if name in _SPREAD else df


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id = nation, one unit per customer."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("doc_id"), F.col("c_custkey").alias("unit_no"),
        F.expr(CONTACT_TEXT).alias("text"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("doc_id"), F.col("c_custkey").alias("unit_no"),
        F.expr(NOTE_TEXT).alias("text"))


def manual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("manual "), F.col("p_size").cast("string"), F.lit(".md")).alias("source_file"),
        F.col("p_partkey").alias("line_no"), F.expr(MANUAL_LINE).alias("line"))


def labels_with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").alias("l").join(table(spark, sf_dir, "documents").alias("d"), "doc_id")


def labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels_with_documents(spark, sf_dir).select(*[F.expr(e).alias(n) for n, e in LABELLED_COLUMNS.items()])


def feedback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.operators.feedback import with_flags

    base = labels_with_documents(spark, sf_dir).select(*[F.expr(e).alias(n) for n, e in FEEDBACK_COLUMNS.items()])
    return with_flags(base)
