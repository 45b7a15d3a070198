import random
import re

from pyspark.sql import Observation
from pyspark.sql import functions as F

from veilspark.functions import hits as H
from veilspark.functions.rules import IDENTIFIER_RULES, MINING_RULES, Rule
from veilspark.operators import detection as D


def found(spark, text, rules=IDENTIFIER_RULES):
    df = spark.createDataFrame([(text,)], "text string").select(F.explode(H.pattern_hits(F.col("text"), rules)).alias("h"))
    return [(r.h.rule, r.h.value, r.h.start, r.h.end) for r in df.collect()]


def test_golden_sentences(spark):
    assert [h[0] for h in found(spark, "주민등록번호 900101-1234567이 기재됨")] == ["rrn"]
    phone, email = found(spark, "연락처는 010-1234-5678이고 이메일은 test@example.com입니다")
    assert phone[1] == "010-1234-5678" and email[1] == "test@example.com"
    assert [h[0] for h in found(spark, "서버 IP는 192.168.0.1이고 VLAN 100, port 8080")] == ["ip", "vlan_port", "vlan_port"]
    assert [h[0] for h in found(spark, "75.450MHz, 02:05:30, 37K500")] == ["freq", "coord", "datetime_precise"]
    assert found(spark, "최지연 씨의 서류가 접수되었습니다.") == []


def by_re(text, rules):
    return [(r.id, m.group(), m.start(), m.end()) for r in rules
            for m in re.compile(r.pattern, re.I if r.ignore_case else 0).finditer(text)]


def test_equals_python_re_on_random_texts(spark):
    rng = random.Random(7)
    pieces = ["010-1234-5678", "02", "12345678901", "a@b.co", "A@B.COM입니다", "10.0.0.1", "8.8.8.8", "M1234567", "AB123456",
              "900101-1234567", "12-34-567890-12", "1234-5678-1234-5678", "23:59:59", "145.500 mhz", "3k123", "VLAN 7", "port８080",
              "20*.23*.9*.71", "1588-1234", "032) 451-3310", "ID: admin", "password=x!", "👍", " ", "\n", "이고", ".", "-", "7", "０１０", " "]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", ","]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    rules = IDENTIFIER_RULES + MINING_RULES
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in df.select("id", F.explode(H.pattern_hits(F.col("text"), rules)).alias("h")).collect():
        got.setdefault(r.id, []).append((r.h.rule, r.h.value, r.h.start, r.h.end))
    for i, t in enumerate(texts):
        assert got.get(i, []) == by_re(t, rules), t
    kept = {r.id for r in df.where(H.may_hit(F.col("text"), rules)).collect()}
    assert kept == {i for i, t in enumerate(texts) if by_re(t, rules)}


def test_identifiers_drop_only_equal_spans(spark):
    df = spark.createDataFrame([("서버 192.168.0.1 외부 8.8.8.8 과 8.8.8.8",)], "text string")
    rows = df.select(F.explode(H.identifier_hits(F.col("text"), IDENTIFIER_RULES, MINING_RULES)).alias("h")).collect()
    assert [(r.h.rule, r.h.value) for r in rows] == [("ip", "192.168.0.1"), ("ip_any", "8.8.8.8"), ("ip_any", "8.8.8.8")]
    rows = df.select(F.explode(H.identifier_hits(F.col("text"), IDENTIFIER_RULES, MINING_RULES, False)).alias("h")).collect()
    assert [r.h.rule for r in rows] == ["ip", "ip_any", "ip_any", "ip_any"]


def test_rules_without_digits_are_not_gated(spark):
    word = Rule("word", "단어", "S", "마스킹", "비밀")
    assert found(spark, "이것은 비밀 문서", (word,)) == [("word", "비밀", 4, 6)]
    assert [h[0] for h in found(spark, "비밀 7@x.co", (word, *IDENTIFIER_RULES))] == ["word", "email"]


def test_name_score_semantics_differ(spark):
    raw = spark.createDataFrame(
        [(1, 0, "PS", None, "김도윤", None, 3, 6, None), (1, 1, "B-PER", None, "이", None, 0, 1, 0.99), (1, 2, "ORG", None, "회사", None, 0, 5, 0.9)],
        "doc_id long, unit_no long, entity_group string, entity string, word string, text string, start int, end int, score double")
    spans = D.adapt_name_spans(raw)
    assert spans.count() == 2
    assert {r.matched for r in D.name_detections(spans).collect()} == {"김도윤", "이"}
    near = raw.drop("text").withColumn("text", F.lit("직원 김도윤의 서류"))
    assert D.inline_name_detections(near, F.col("text")).count() == 0
    assert [r.matched for r in D.inline_name_detections(near, F.col("text"), 0.0).collect()] == ["김도윤"]
    assert D.inline_name_detections(near, F.col("text"), 0.0, "sheet").count() == 2


def test_classifier_gate(spark):
    texts = ["Step 1", "Step 1. verify", "Step 1. 카드 재부팅 절차를 수행합니다"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(D.skips_classifier(F.col("text"))).collect()] == [True, True, False]


def test_order_regex_names_context(spark):
    units = spark.createDataFrame([(1, 0, "직원 김도윤의 번호 010-1234-5678"), (1, 1, "장비 구성 방식과 운용 절차를 설명한다")], "doc_id long, unit_no long, text string")
    names = spark.createDataFrame([(1, 0, "PS", None, "김도윤", 3, 6, 0.95)], "doc_id long, unit_no long, entity_group string, entity string, word string, start int, end int, score double")
    preds = spark.createDataFrame([(1, 0, 0.9, 0.1, 0.0), (1, 1, 0.7, 0.2, 0.1)], "doc_id long, unit_no long, p_c double, p_s double, p_o double")
    rows = {r.unit_no: r.detections for r in D.detect_units(units, names=names, predictions=preds).collect()}
    # Names need more than two characters.
    assert [(d.ord, d.source) for d in rows[0]] == [(0, "regex"), (1, "ner")]
    assert [(d.ord, d.source, d.grade, d.sensitive_category) for d in rows[1]] == [(0, "ai", "C", "AI_C")]
    assert rows[1][0].reason == "AI 문장분류 grade=C / confidence=0.7000 / threshold=0.60 / probs=(C=0.700, S=0.200, O=0.100)"


def test_exact_decimals(spark):
    from veilspark.functions.text import fixed

    values = [0.40625, 0.4875, 0.28125, 0.0, 1.0, 0.99996, 0.00005, 1 / 3, 0.0625, 0.45, 0.00015, 0.0005, 0.00385, 0.0035]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for d in (3, 4):
        assert [r[0] for r in df.select(fixed(F.col("x"), d)).collect()] == [f"{v:.{d}f}" for v in values]
    percent = [100 * v for v in values]
    df = spark.createDataFrame([(v,) for v in percent], "x double")
    assert [r[0] for r in df.select(fixed(F.col("x"), 1)).collect()] == [f"{v:.1f}" for v in percent]


def test_failed_scorers_are_counted(spark):
    text = "담당 업무 절차와 장비 구성 방식을 정리한 문서"
    units = spark.createDataFrame([(1, i, text if i else "010-1234-5678") for i in range(6)] + [(2, 0, text)], "doc_id long, unit_no long, text string")
    names = spark.createDataFrame([(1, 1, "PER", "담당", 0, 3, 0.9, None), (1, 2, "PER", "담당", 0, 3, 0.9, "timeout")],
                                  "doc_id long, unit_no long, entity_group string, word string, start int, end int, score double, error string"
                                  ).withColumn("entity", F.lit(None).cast("string"))
    predictions = spark.createDataFrame([(1, i, 0.9, 0.05, 0.05, "down" if i == 4 else None) for i in (1, 2, 4)], "doc_id long, unit_no long, p_c double, p_s double, p_o double, error string")
    seen = Observation("scorers")
    detected = D.detect_units(units, names=names, predictions=predictions)
    got = {r.doc_id: (r.units, r.ner_failed, r.ai_failed) for r in D.scorer_failures(detected, seen).collect()}
    assert got == {1: (6, 1, 3), 2: (1, 0, 1)}  # units 3 and 5 have no prediction, unit 4 an error; unit 0 needs none
    assert seen.get == {"units": 7, "ner_failed": 1, "ai_failed": 4}
    assert {(r.unit_no, d.source) for r in detected.where("doc_id = 1").collect() for d in r.detections} == {(0, "regex"), (1, "ner"), (1, "ai"), (2, "ai")}
    assert "failed" not in D.detect_units(units).columns


def test_values_that_come_twice_have_their_own_places(spark):
    """A value can also be part of something that is no hit."""
    text = "91234567890123456 a@b.co xa@b.co a@b.co 12:30:45 112:30:45 VLAN 1 VLAN 12"
    for r in IDENTIFIER_RULES:
        flags = re.I if r.ignore_case else 0
        assert found(spark, text, [r]) == [(r.id, m[0], m.start(), m.end()) for m in re.finditer(r.pattern, text, flags)]


def test_values_found_once_are_placed_without_splitting(spark):
    """Splitting costs a pass and compiles the pattern for every row."""
    df = spark.createDataFrame([("메일 a@b.co 끝",)], "text string")
    rule = Rule("x", "x", "S", "x", r"a@b\.co")
    hits = df.select(H.pattern_hits(F.col("text"), [rule]).alias("h"))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "locate" in plan
    assert [(h.value, h.start, h.end) for h in hits.first().h] == [("a@b.co", 3, 9)]


def test_texts_of_detector_rows_are_not_broadcast(spark):
    units = spark.range(50).select(F.lit(1).alias("doc_id"), F.col("id").alias("unit_no"), F.lit("전화 010-1234-5678").alias("text"))
    rows = units.select("doc_id", "unit_no", F.lit("전화번호").alias("label"), F.lit(3).alias("start"), F.lit(16).alias("end"))
    n = D.normalize_detector_output(rows, units)
    assert "Broadcast" not in n._jdf.queryExecution().executedPlan().toString()
    assert {r.matched for r in n.collect()} == {"010-1234-5678"}
