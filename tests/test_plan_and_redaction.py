import random

from pyspark.sql import functions as F

from veilspark.functions import location as L
from veilspark.operators import deid_plan as P
from veilspark.operators import redaction as R
from veilspark.operators.detection import DETECTIONS

FIELDS = ["ord", "label", "matched", "grade", "action", "source", "start", "end", "sensitive_type", "sensitive_category", "reason"]


def det(ord_, start, end, source="regex", grade="S", action="마스킹", text="x" * 60, label=None, matched=None):
    m = text[start:end] if matched is None and start is not None else (matched or "")
    return (ord_, label or f"L{ord_}", m, grade, action, source, start, end, None, None, f"r{ord_}")


def planned(spark, groups, texts=None):
    rows = [(1, i, (texts or ["x" * 60] * len(groups))[i], g) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, f"doc_id long, unit_no long, text string, detections {DETECTIONS}")
    return P.plan_units(df)


def kept(spark, *dets):
    return [(t.label, t.start, t.end, t.reason) for t in planned(spark, [list(dets)]).first().auto_targets]


def test_source_beats_order(spark):
    got = kept(spark, det(0, 3, 6, "ner"), det(1, 3, 6, "regex"))
    assert got == [("L1", 3, 6, "r1 / 중복 탐지 흡수: source=ner, label=L0, matched=xxx")]
    assert [g[0] for g in kept(spark, det(0, 9, 13, "ner"), det(1, 9, 25))] == ["L1"]


def test_sorted_by_start(spark):
    assert [g[0] for g in kept(spark, det(0, 35, 46, grade="C"), det(1, 9, 25))] == ["L1", "L0"]


def test_touching_spans_stay(spark):
    assert len(kept(spark, det(0, 0, 3), det(1, 3, 6))) == 2


def test_residual_overlap_survives(spark):
    got = kept(spark, det(0, 0, 3), det(1, 5, 9), det(2, 2, 12))
    assert [(g[0], g[1], g[2]) for g in got] == [("L2", 2, 12), ("L1", 5, 9)]


def test_review_is_separate_and_not_deduplicated(spark):
    row = planned(spark, [[det(0, 0, 3), det(1, None, None, "ai", action="검토 필요"), det(2, None, None, "ai", action="검토 필요")]]).first()
    assert [t.label for t in row.auto_targets] == ["L0"] and [t.label for t in row.review_targets] == ["L1", "L2"]


SRC, GR = {"regex": 1, "ner": 2, "ai": 3}, {"C": 3, "S": 2, "O": 1}


def brute(dets):
    """Plain statement of the rule on dicts."""
    out = []
    for c in (dict(zip(FIELDS, d)) for d in dets):
        for i, k in enumerate(out):
            if k["start"] < c["end"] and c["start"] < k["end"]:
                def pref(d):
                    return (SRC[d["source"]], -GR[d["grade"]], -len(d["matched"]), d["ord"])
                win, lose = (k, c) if pref(k) <= pref(c) else (c, k)
                win["reason"] += f" / 중복 탐지 흡수: source={lose['source']}, label={lose['label']}, matched={lose['matched']}"
                out[i] = win
                break
        else:
            out.append(c)
    return sorted(out, key=lambda d: d["start"])


def random_groups(seed, n=250):
    rng = random.Random(seed)
    groups = []
    for _ in range(n):
        g = []
        for o in range(rng.randint(0, 9)):
            s = rng.randint(0, 40)
            g.append(det(o, s, s + rng.randint(1, 12), rng.choice(["regex", "ner"]), rng.choice("CSO"), rng.choice(["마스킹", "삭제"])))
        groups.append(g)
    return groups


def test_fold_equals_brute_force_in_both_forms(spark):
    groups = random_groups(3)
    rows = {r.unit_no: r for r in planned(spark, groups).collect()}
    for i, g in enumerate(groups):
        want = [(d["label"], d["start"], d["end"], d["reason"]) for d in brute(g)]
        assert [(t.label, t.start, t.end, t.reason) for t in rows[i].auto_targets] == want
    flat = [(1, i, "x" * 60, f"L{i}") + d for i, g in enumerate(groups) for d in g]
    df = spark.createDataFrame(
        flat, "doc_id long, unit_no long, context string, location_label string, ord long, label string, matched string, grade string, "
        "action string, source string, start int, end int, sensitive_type string, sensitive_category string, reason string"
    ).withColumn("loc", L.no_location())
    got = {}
    for r in P.plan_detections(df).orderBy("doc_id", "track", "first_seen", "start", "slot").collect():
        got.setdefault(r.location_label, []).append((r.label, r.start, r.end, r.reason))
    for i, g in enumerate(groups):
        assert got.get(f"L{i}", []) == [(d["label"], d["start"], d["end"], d["reason"]) for d in brute(g)]


def test_a_hot_location_is_swept_in_runs(spark):
    rng = random.Random(8)
    spans = []
    for o in range(600):
        s = rng.randrange(0, 4000)
        spans.append(det(o, s, s + rng.choice([1, 2, 5, 30]), rng.choice(["regex", "ner"]), rng.choice("CSO"), "마스킹", text="x" * 5000))
    rows = [(1, 7, f"context {d[0] % 2}", "L") + d for d in spans] + [(2, 7, None, "L") + d for d in spans[:5]]
    df = spark.createDataFrame(
        rows, "doc_id long, unit_no long, context string, location_label string, ord long, label string, matched string, grade string, "
        "action string, source string, start int, end int, sensitive_type string, sensitive_category string, reason string"
    ).withColumn("loc", L.no_location())
    want = [(d["label"], d["start"], d["end"], d["reason"]) for d in brute(spans)]
    for run in (50, P.RUN, None):
        got = P.plan_detections(df, run=run).where("doc_id = 1").collect()
        assert sorted((r.start, r.slot.ord, r.label, r.end, r.reason) for r in got) and sorted((r.label, r.start, r.end, r.reason) for r in got) == sorted(want)
        assert all(r.context == f"context {r.order.ord % 2}" and r.first_seen == min(got, key=lambda x: x.slot).order for r in got)
    islands = P.with_islands(df.where("doc_id = 1").withColumn("_o", F.struct("unit_no", "ord")), ("doc_id", "location_label"), "_o", 50)
    reach, n = -1, 0
    for s, e in sorted((d[6], d[7]) for d in spans):
        n += s >= reach
        reach = max(reach, e)
    assert islands.select("_island").distinct().count() == n


def test_places_with_some_of_fields_label_and_context(spark):
    """All patterns of missing fields, label and context, mixed in one document, against the pairwise rule."""
    rng = random.Random(4)
    docs = []
    for doc in range(30):
        spans = []
        for o in range(rng.randrange(2, 12)):
            s = rng.randrange(20)
            place = (rng.choice([None, 1, 2]), rng.choice([None, "A", "B"]), rng.choice([None, "c", "d"]))
            spans.append((det(o, s, s + rng.randint(1, 6), rng.choice(["regex", "ner"]), rng.choice("CSO"), "마스킹"), place))
        docs.append(spans)

    def same(a, b):
        if a[0] and b[0]:
            return a[0] == b[0]
        return a[1] == b[1] if a[1] is not None or b[1] is not None else a[2] == b[2]

    def fold(spans):
        out = []
        for d, place in spans:
            c = dict(zip(FIELDS, d)) | {"place": place}
            for i, k in enumerate(out):
                if k["start"] < c["end"] and c["start"] < k["end"] and same(k["place"], place):
                    pref = lambda x: (SRC[x["source"]], -GR[x["grade"]], -len(x["matched"]), x["ord"])
                    win, lose = (k, c) if pref(k) <= pref(c) else (c, k)
                    win["reason"] += f" / 중복 탐지 흡수: source={lose['source']}, label={lose['label']}, matched={lose['matched']}"
                    out[i] = win
                    break
            else:
                out.append(c)
        return sorted((x["label"], x["start"], x["end"], x["reason"]) for x in out)

    rows = [(doc, 7, place[2], place[1], place[0]) + d for doc, spans in enumerate(docs) for d, place in spans]
    df = spark.createDataFrame(
        rows, "doc_id long, unit_no long, context string, location_label string, p int, ord long, label string, matched string, grade string, "
        "action string, source string, start int, end int, sensitive_type string, sensitive_category string, reason string"
    ).withColumn("loc", L.location(paragraphNo=F.col("p"))).drop("p")
    for run in (None, 5):
        got = {}
        for r in P.plan_detections(df, run=run).collect():
            got.setdefault(r.doc_id, []).append((r.label, r.start, r.end, r.reason))
        for doc, spans in enumerate(docs):
            assert sorted(got[doc]) == fold(spans)


def test_a_document_is_dealt_by_location(spark, monkeypatch):
    """One document of many locations is worked on by many tasks, its rows are shuffled once, its texts not at all."""
    rng = random.Random(6)
    rows = []
    for n in range(300):
        for o in range(rng.randrange(1, 5)):
            s = rng.randrange(30)
            rows.append((n % 2, n, f"context {n}" + "x" * 60, f"L{n}", None if n == 7 else n) + det(o, s, s + 8))
    schema = ("doc_id long, unit_no long, context string, location_label string, p int, ord long, label string, matched string, grade string, "
              "action string, source string, start int, end int, sensitive_type string, sensitive_category string, reason string")

    def located(rows):
        return spark.createDataFrame(rows, schema).withColumn("loc", L.location(paragraphNo=F.col("p"))).drop("p")

    def plan(df, **options):
        return P.plan_detections(df, **options).where("track = 'auto'").drop("loc")

    even = located([r for r in rows if r[0] == 0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        t = plan(even, places=False)
        assert t.select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert not {"loc_key", "context", "location_label"} & set(t.columns)
        t.collect()
        assert "ReusedExchange" in t._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    # Document 1 has fields in part; whichever documents the marks take along with it, the targets are the same.
    want = sorted(map(str, plan(located(rows)).collect()))
    monkeypatch.setattr(P, "MARKS", 1)
    assert sorted(map(str, plan(located(rows)).collect())) == want
    assert sorted(map(str, plan(located(rows), run=1000).collect())) == want
    kept = ("doc_id", "slot", "label", "start", "end", "reason")
    assert sorted(plan(located(rows), places=False).select(*kept).collect()) == sorted(plan(located(rows)).select(*kept).collect())


def brute_apply(text, targets, mode):
    warnings, n = [], 0
    for t in sorted(targets, key=lambda d: -d["start"]):
        if t["end"] > len(text):
            warnings.append("range")
            continue
        piece = text[t["start"]:t["end"]]
        if t["matched"] and t["matched"] != piece:
            warnings.append("matched")
        repl = ("(삭제됨)" if mode == "mark" else "") if t["action"] == "삭제" else "*" * len(piece)
        text, n = text[:t["start"]] + repl + text[t["end"]:], n + 1
    return text, n, warnings


def test_apply_equals_brute_force(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("가나다abc 👍") for _ in range(60)) for _ in range(120)]
    groups = []
    for t in texts:
        g = []
        for o in range(rng.randint(1, 6)):
            s = rng.randint(0, 50)
            e = min(60, s + rng.randint(1, 15))
            g.append(det(o, s, e, action=rng.choice(["마스킹", "삭제"]), text=t))
        groups.append(g)
    for mode in ("delete", "mark"):
        rows = planned(spark, groups, texts).select(
            "unit_no", "auto_targets", R.apply_to_text(F.col("text"), F.col("auto_targets"), mode).alias("r")).collect()
        for r in rows:
            want = brute_apply(texts[r.unit_no], [t.asDict() for t in r.auto_targets], mode)
            assert (r.r.text, len(r.r.applied)) == want[:2]
            assert len(r.r.warnings) == len(want[2])


def apply_one(spark, text, start, end, action="마스킹", matched="", mode="delete"):
    df = spark.createDataFrame([(text, [det(0, start, end, action=action, matched=matched)])], f"text string, ts {DETECTIONS}")
    return df.select(R.apply_to_text(F.col("text"), F.col("ts"), mode).alias("r")).first().r


def test_apply_golden(spark):
    assert apply_one(spark, "직원 김도윤의 서류", 3, 6).text == "직원 ***의 서류"
    s = "서버 IP는 192.168.0.1입니다."
    assert apply_one(spark, s, 7, 18, "삭제").text == "서버 IP는 입니다."
    assert apply_one(spark, s, 7, 18, "삭제", mode="mark").text == "서버 IP는 (삭제됨)입니다."
    off = apply_one(spark, s, 7, 18, matched="192.168.0.12")
    assert len(off.applied) == 1 and "matched와 실제" in off.warnings[0]
    for start, end, word in ((-1, 3, "0보다 작습니다"), (0, 100, "초과합니다"), (6, 3, "크거나 같습니다"), (None, None, "None입니다")):
        r = apply_one(spark, s, start, end)
        assert r.text == s and word in r.skipped[0].reason and len(r.warnings) == 1
    assert apply_one(spark, s, 0, 2, "검토 필요").skipped[0].reason == R.REVIEW_REASON


def test_normalized_form_mismatch_is_its_own_warning(spark):
    import unicodedata

    nfd = unicodedata.normalize("NFD", "김도윤")
    text = f"직원 {nfd} 서류"
    loc = L.location(fileType=F.lit("pdf"), section=F.lit("text_line"), pageNo=F.lit(0), lineNo=F.lit(0))
    units = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("loc", loc)
    t = spark.createDataFrame([("김도윤", 3, 3 + len(nfd)), ("다른 글", 3, 6)], "matched string, start int, end int").select(
        F.lit(1).cast("long").alias("doc_id"), F.lit("auto").alias("track"), F.lit(0).alias("first_seen"), F.col("end").alias("slot"),
        F.lit("성명").alias("label"), "matched", F.lit("S").alias("grade"), F.lit("마스킹").alias("action"), F.lit("ner").alias("source"),
        "start", "end", F.lit(None).cast("string").alias("sensitive_type"), F.lit(None).cast("string").alias("sensitive_category"),
        F.lit("").alias("reason"), F.lit(unicodedata.normalize("NFC", text)).alias("context"), F.lit("1쪽").alias("location_label"), loc.alias("loc"))
    item = R.guide_items(t, units, "pdf").first()
    assert item.status == "skipped" and item.skipped_target_count == 2
    # Contexts equal after normalisation are no mismatch.
    assert sorted(w.split("]")[0] for w in item.warnings) == ["[slice_mismatch", "[unicode_normalization_mismatch"]


def test_same_location_contexts_differ(spark):
    rows = spark.createDataFrame(
        [(1, 0, 0, "가 나", 0, 1), (1, 1, 0, "가 다", 2, 3)], "doc_id long, unit_no long, ord long, context string, start int, end int").select(
        "*", F.lit("L").alias("location_label"), L.no_location().alias("loc"), F.lit("x").alias("label"), F.lit("가").alias("matched"), F.lit("S").alias("grade"),
        F.lit("마스킹").alias("action"), F.lit("regex").alias("source"), F.lit(None).cast("string").alias("sensitive_type"),
        F.lit(None).cast("string").alias("sensitive_category"), F.lit("").alias("reason"))
    r = R.apply_plan(P.plan_detections(rows)).first()
    assert r.applied_text == "* *" and R.CONTEXTS_DIFFER in r.plan_warnings[0]


def test_unreadable_documents(spark):
    docs = spark.createDataFrame([(1, "a.pdf", None), (2, "b.pdf", "locked"), (3, "c.pdf", None)], "doc_id long, path string, load_error string")
    units = spark.createDataFrame([(1, "글")], "doc_id long, text string")
    codes = {r.doc_id: r.warning.split("]")[0][1:] for r in R.unreadable_warnings(docs, units).collect()}
    assert codes == {2: "pdf_encrypted", 3: "scanned_pdf_no_text"}
