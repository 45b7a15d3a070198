import os

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from veilspark.functions.keywords import KeywordPack
from veilspark.operators import curation as C
from veilspark.operators import evaluation as E
from veilspark.operators import mining as M
from veilspark.operators import modeling as ML
from veilspark.plans import flows


def test_clean_text(spark):
    cases = {
        "① A/S 접수 / 처리": "A/S 접수 처리", "( 내용 )": "(내용)", "빈 ( ) 칸": "빈 칸", "1/2/3": "1/2/3", " #REF! ": "[CORRUPTED_EXCEL_FORMULA]",
        "가가 나 .": "가가 나.", "줄\n바꿈\t탭": "줄 바꿈 탭", " 항목": "항목",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, "")], "text string, want string")
    for r in C.clean_dataset(df).collect():
        assert r.text == r.want


def test_compact_removes_the_letter_s_but_no_space(spark):
    df = spark.createDataFrame([("s A B|s·ss-x",)], "t string")
    assert df.select(M.compact(F.col("t"))).first()[0] == " A Bx"


def test_noise_golden(spark):
    cases = {"전면 LED 표시 상태 확인": "too_short", "문서 목적 및 적용 범위를 설명하는 문장입니다": "open_content", "설 비 명 주 제 어 장 치 가 나 다 라 마 바 사 아 자": "scattered",
             "장애 발생 시 카드 리셋 후 재기동한다 그리고 보고한다": None}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    for r in df.select("t", "want", M.noise_reason(F.col("t"), F.lit("")).alias("got")).collect():
        assert r.got == r.want, r.t


def test_empty_labelled_set_and_missing_columns(spark):
    df = spark.createDataFrame([], "id string, text string, cso_grade string")
    assert [r.rule for r in C.label_issues(df).collect()] == ["FILE"]
    df = spark.createDataFrame([("1", "글", "Z")], "id string, text string, cso_grade string")
    rules = sorted(r.rule for r in C.label_issues(df).collect())
    assert rules == ["COLUMN"] * 9 + ["R2"]


def test_regrade_golden(spark):
    rows = [("납품 단가 협의 결과를 공유드립니다", "계약정보", "C", "Y", "N", "S"), ("우울증 치료 이력이 기록되어 있습니다", "건강정보", "S", "N", "Y", "C"),
            ("내부망 구성도 및 서버 IP 목록을 첨부합니다", "보안정보", "C", "Y", "N", "C"), ("회의는 오후 3시에 진행됩니다", "일반업무", "O", "N", "N", "O"),
            ("C등급은 기밀 정보입니다", "분류설명", "C", "Y", "N", "O")]
    df = spark.createDataFrame(rows, "text string, sensitive_category string, cso_grade string, has_sensitive_business string, has_sensitive_legal string, want string"
                               ).withColumn("has_personal", F.lit("N"))
    out = C.regrade(df)
    assert all(r.label == r.want for r in out.collect())
    assert C.failed_expectations(out, {r[0]: r[5] for r in rows}).count() == 0


def ngrams(text, lo=2, hi=4):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        for n in range(lo, hi + 1):
            if n > lo and len(w) < n:
                break
            out += [w[i:i + n] for i in range(max(len(w) - n + 1, 1))]
    return sorted(out)


def test_tokens(spark):
    texts = ["a 가나다 LED", "  서버 x ", ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(F.expr(ML.word_bounded_ngrams_sql("text")).alias("t"), F.expr(ML.char_ngrams_sql("text")).alias("c"), F.expr(ML.word_ngrams_sql("text")).alias("w")).collect()
    for t, r in zip(texts, got):
        assert sorted(r.t) == ngrams(t)
    assert got[0].c[:4] == ["a ", " 가", "가나", "나다"] and got[0].w == ["가나다", "led", "가나다 led"] and got[2].c == []


def labelled(spark):
    kinds = {"C": ["복구 절차와 카드 리셋 순서", "보호장치 해제 절차"], "S": ["계약 단가와 견적 금액", "업체 평가 결과 보고"], "O": ["회의 일정을 안내합니다", "식당 메뉴를 안내합니다"]}
    rows = [(i * 6 + j, f"{t} {i}호", g, "0") for i in range(8) for j, (g, t) in enumerate((g, t) for g, ts in kinds.items() for t in ts)]
    return spark.createDataFrame(rows, "id long, text string, label string, augmented string")


def test_logistic_model_learns_separable_grades(spark):
    model = ML.train_grade_model(labelled(spark), "lr_char", max_iter=10, width=1 << 12)
    probe = spark.createDataFrame([("회의 메뉴를 안내합니다", "O"), ("복구 절차와 카드 리셋", "C"), ("계약 단가", "S")], "text string, label string")
    scored = model.score(probe).collect()
    assert all(r.pred == r.label and abs(r.p_c + r.p_s + r.p_o - 1) < 1e-6 for r in scored)


def test_no_term_is_dropped(spark):
    df = spark.range(400).select(F.concat(F.lit("낱말"), F.col("id").cast("string")).alias("text"))
    out = ML.fit_features(df, ("word",), width=64).transform(df)
    assert out.where(vector_to_array("tf_word")[0].isNull() | (F.aggregate(vector_to_array("tf_word"), F.lit(0.0), lambda a, x: a + x) != 1.0)).count() == 0


def test_word_ngrams_are_indexed_like_terms(spark):
    texts = ["", " \u3000 ", "a", "ab\u2028Cd\u00a0ef", "\U0001f600", "\U0001f600x Ünï 가나다라 복구 복구\t x\u200bz", None, "word " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    words = df.selectExpr("id", f"{ML.spaced_words_sql('text')} as w")
    terms = df.where("text is not null").selectExpr("id", f"{ML.word_bounded_ngrams_sql('text')} as t")
    for width in (64, 1 << 18):
        want = {r.id: r.v for r in ML.HashingTF(inputCol="t", outputCol="v", numFeatures=width).transform(terms).collect()}
        got = {r.id: r.v for r in ML.HashedWordNgrams(inputCol="w", outputCol="v", numFeatures=width).transform(words).collect()}
        assert got.pop(6).numNonzeros() == 0 and got == want


def test_training_rows_of_one_file_are_dealt_over_the_cores(spark, monkeypatch):
    from veilspark.operators import linear

    found, fit = [], ML.fit_softmax
    monkeypatch.setattr(linear, "ROWS_PER_TASK", 4)
    monkeypatch.setattr(ML, "fit_softmax", lambda rows, *a: found.append(rows.chunks.glom().map(len).collect()) or fit(rows, *a))
    model = ML.train_grade_model(labelled(spark).coalesce(1), width=1 << 10, max_iter=3)
    assert sum(n > 0 for n in found[0]) > 1 and model.iterations <= 3


def test_registered_model_has_the_full_width(spark, monkeypatch):
    from veilspark_checks import queries as Q

    tables = {
        "documents": labelled(spark).select(F.col("id").alias("doc_id"), "text"),
        "labels": labelled(spark).select(F.col("id").alias("doc_id"), (F.col("label") == "C").cast("int").alias("toxic"), (F.col("label") == "O").cast("int").alias("quality"))}
    asked = []
    train = ML.train_grade_model
    monkeypatch.setattr(Q, "table", lambda spark, sf, name: tables[name])
    monkeypatch.setattr(ML, "train_grade_model", lambda *a, **k: asked.append(k) or train(*a, **k | {"max_iter": 3}))
    scored = Q.grade_model_scores(spark, "")
    assert scored.count() == 48 and "width" not in asked[0]
    features = ML.fit_features(labelled(spark)).transform(labelled(spark)).schema["features"].metadata
    assert features["ml_attr"].keys() <= {"num_attrs"}  # no name for each of 2^18 indexes


def test_model_variants_are_compared(spark):
    pack = KeywordPack(roles={"strong_procedural": ["복구 절차"], "s_business_sensitive": ["단가"], "weak": ["안내"]})
    rows = labelled(spark).union(E.regression_set(spark).select(F.xxhash64("text").alias("id"), "text", "label", F.lit("1")))
    counts, models = flows.compare_models(rows, ("lr_char", "svc_char_word_keyword"), pack=pack, width=1 << 12)
    summary = E.model_summary(counts).collect()
    assert len(summary) == 2 and all(r.accuracy > 0.95 for r in summary)
    assert E.best_model(E.model_summary(counts)).count() == 1
    assert len(E.REGRESSION_SENTENCES) == 8
    for m in models.values():
        assert E.regressions(m.score(E.regression_set(spark))).count() == 0
    assert E.regressions(models["lr_char"].score(E.regression_set(spark)), "S").count() == 8


def test_the_last_row_of_a_text_counts(spark):
    rows = spark.createDataFrame([("a", "S", 2), ("a", "O", 1), ("b", "C", 3)], "text string, label string, no int").coalesce(1)
    want = {"a": "O", "b": "C", "c": "S"}
    assert [tuple(r) for r in C.failed_expectations(rows, want).collect()] == [("c", "S", None)]
    assert sorted(tuple(r) for r in C.failed_expectations(rows, want, "no").collect()) == [("a", "O", "S"), ("c", "S", None)]


def test_augmented_rows_never_reach_the_test_part(spark):
    df = labelled(spark).withColumn("augmented", F.when(F.col("id") % 4 == 0, "1").otherwise("0"))
    out = ML.stratified_split(df, "id")
    assert out.count() == 48 and out.where("part = 'test' and augmented = '1'").count() == 0


def test_reports_have_all_labels(spark):
    df = spark.createDataFrame([("C", "S"), ("C", "C")], "truth string, pred string")
    c = E.confusion_counts(df)
    assert [tuple(r) for r in E.confusion_matrix(c).collect()] == [("C", 1, 1, 0), ("S", 0, 0, 0), ("O", 0, 0, 0)]
    assert {r.grade: (r.precision, r.recall, r.f1) for r in E.class_report(c).collect()}["S"] == (0.0, 0.0, 0.0)


def test_quick_classes_hold_the_same_characters(spark):
    from veilspark.functions import text as T

    chars = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    space, line = F.col("c").rlike(T.SPACE), F.col("c").rlike(f"^(?:{T.LINE_END})$")
    assert chars.where(F.col("c").rlike(T.QUICK_SPACE) != space).count() == 0
    assert chars.where((F.size(T.lines(F.col("c"))) == 2) != line).count() == 0


def test_empty_brackets_side_by_side_leave_one_space(spark):
    df = spark.createDataFrame([("가 ( ) () ()  \n　나 ( 다\t) . 라\r\n,",)], "text string")
    assert df.select(C.tidy_spacing(F.col("text"))).first()[0] == "가 나 (다). 라,"
    plan = df.select(C.tidy_spacing(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" not in plan  # it looks every character up by itself


def test_words_are_runs_of_word_characters(spark):
    """As told by word borders, which cost more."""
    texts = ["a bb  ccc_d é éé Straße-Weg 가 가나 x1 1 22 éf ́g _ __ ab‍cd Ⅷx", "", "z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    tokens = ML.word_ngrams_sql("text")
    assert "\\b" not in tokens and "array_join" not in tokens
    words = F.expr(r"regexp_extract_all(lower(text), '(?U)\\b\\w\\w+\\b', 0)")
    for got, want in df.select(F.expr(tokens), words).collect():
        assert got == want + [f"{a} {b}" for a, b in zip(want, want[1:])]
