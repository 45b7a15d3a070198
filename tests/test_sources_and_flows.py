import csv
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions.keywords import pack_from_config
from veilspark.operators import feedback as FB
from veilspark.operators import mining, units
from veilspark.plans import flows
from veilspark.sources import corpus, delimited, feedback_files, routing, sinks
from veilspark.streaming import feedback_stream as S


def put(folder, name, data):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_delimited_files_of_every_encoding(spark, folder):
    put(folder, "a.csv", "이름,전화\n김도윤,010-1234-5678\n".encode("utf-8-sig"))
    put(folder, "b.csv", "이름;메모\n\"이;서연\";\"줄\n바꿈\"\n".encode("cp949"))
    put(folder, "c.csv", "x\n192.168.0.1\n".encode())
    rows = delimited.read_delimited(spark, folder)
    got = {(os.path.basename(r.path), r.row_no): r.cells for r in rows.collect()}
    assert got == {
        ("a.csv", 1): ["이름", "전화"], ("a.csv", 2): ["김도윤", "010-1234-5678"], ("b.csv", 1): ["이름", "메모"],
        ("b.csv", 2): ["이;서연", "줄\n바꿈"], ("c.csv", 1): ["x"], ("c.csv", 2): ["192.168.0.1"]}
    red = delimited.redact_rows(rows)
    assert {r.cells[-1] for r in red.where("row_no = 2").collect()} == {"*************", "줄\n바꿈", "(삭제됨)"}
    h = delimited.with_headers(rows).withColumn("doc_id", F.col("path"))
    u = units.cell_units(h, F.col("cells"), F.col("headers"), F.col("row_no"))
    assert "2행 전화열" in {r.location_label for r in u.collect()}
    items = flows.applied_cells(u).items.collect()
    assert sorted((i.original_text, i.status) for i in items) == [("010-1234-5678", "applied"), ("192.168.0.1", "applied")]
    out = os.path.join(folder, "out")
    delimited.write_redacted(red.where(F.col("path").endswith("a.csv")), out)
    parts = [open(os.path.join(r, f), encoding="utf-8", newline="").read() for r, _, fs in os.walk(out) for f in fs if f.startswith("part")]
    assert "".join(sorted(parts, reverse=True)) == "﻿이름,전화\r\n김도윤,*************\r\n"


def test_delimited_rows_of_differing_width_keep_their_cells(spark, folder):
    for sub in ("x", "y"):
        os.mkdir(os.path.join(folder, sub))
    put(folder, "0.csv", b"title\nonly\n")
    put(folder, "x/a.csv", b"name,phone\nkim,010-1111-2222\nlee,010-3333-4444,extra,\n\n,\n")
    put(folder, "y/a.csv", b"name;phone\nkim;010-1111-2222\nlee;010-3333-4444\n")
    paths = [os.path.join(folder, f) for f in ("0.csv", "x/a.csv", "y/a.csv")]
    rows = delimited.read_delimited(spark, paths)
    got = {}
    for r in rows.orderBy("path", "row_no").collect():
        got.setdefault(r.path.split(folder + "/")[-1], []).append(r.cells)
    assert got == {
        "0.csv": [["title"], ["only"]],
        "x/a.csv": [["name", "phone"], ["kim", "010-1111-2222"], ["lee", "010-3333-4444", "extra", ""], [], ["", ""]],
        "y/a.csv": [["name", "phone"], ["kim", "010-1111-2222"], ["lee", "010-3333-4444"]]}
    assert {r.path.split(folder + "/")[-1]: r.delimiter for r in delimited.profile_files(spark, paths).collect()}["y/a.csv"] == ";"
    out = os.path.join(folder, "out")
    delimited.write_redacted(delimited.redact_rows(rows).coalesce(1), out)
    back = spark.read.option("wholetext", True).text(out).collect()
    assert len({(r.folder, r.file) for r in back}) == 3
    lines = {(r.folder.rstrip("/")[-1], line) for r in back for line in r.value.replace("\ufeff", "").split("\r\n")}
    assert {("x", "lee,*************,extra,"), ("x", ","), ("x", ""), ("y", "kim;*************")} <= lines


def test_blocks_of_a_file_are_read_as_one(spark, folder):
    """Random quoting in files of every encoding, cut into blocks of a few lines, against the whole-file reader."""
    r = random.Random(5)
    want = {}
    for i in range(12):
        text = "h1,h2,h3\n" + "".join(r.choice(["a", "b", ",", '"', "\n", "\r\n" if i % 3 else "\n", "é" if i % 4 == 1 else "가"]) for _ in range(300))
        data = text.encode("utf-8-sig" if i % 4 == 0 else "utf-8" if i % 4 == 1 else "cp949")
        if i % 4 == 3:
            data = b"\xef\xbb\xbf" * (i % 8 == 3) + data + b'\xff\xfe"\n'
        put(folder, f"{i}.csv", data)
        for encoding in ("utf-8-sig", "cp949"):
            try:
                want[f"{i}.csv"] = data.decode(encoding)
                break
            except UnicodeDecodeError:
                want[f"{i}.csv"] = data.decode("utf-8", errors="replace")
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(c) for c in sizes]
    try:
        for size in ("61", "128m"):
            spark.conf.set(sizes[0], size)
            spark.conf.set(sizes[1], "0")
            got, delimiters = {}, {}
            for x in delimited.read_delimited(spark, folder).collect():
                name = os.path.basename(x.path)
                assert x.row_no not in got.setdefault(name, {})
                got[name][x.row_no], delimiters[name] = x.cells, x.delimiter
            for name, text in want.items():
                rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiters[name]))
                assert [got[name].get(n + 1) for n in range(len(rows))] == rows and len(got[name]) == len(rows), name
    finally:
        for c, v in zip(sizes, before):
            spark.conf.set(c, v)


def test_a_cell_longer_than_the_csv_module_allows_by_itself(spark, folder):
    long = "x" * 150_000 + '"\n,' + "y" * 150_000
    put(folder, "long.csv", ("a,b\n1," + '"' + long.replace('"', '""') + '"\n2,c\n').encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
        rows = {r.row_no: r.cells for r in delimited.read_delimited(spark, folder).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {1: ["a", "b"], 2: ["1", long], 3: ["2", "c"]}


def test_delimiter_beside_quoted_cells_that_hold_another(spark, folder):
    """Heads on which the sniffer takes the comma inside the quoted cells for the delimiter."""
    texts = [("1461", "en", "Atha the an of and.", 0), ("5679", "fr", "Anier aieux. Le de.", 19), ("4153", "en", "To ndor at and blesh.", 13),
             ("3953", "es", "De cias la asta en la.", 13), ("3345", "en", "Hest thou ereaat thnd a.", 5), ("1533", "en", "Thanonmfd thates ly.", 0)]
    with open(f"{folder}/a.csv", "w", newline="") as f:
        f.write("".join(f'{i};{lang};{text};"""src{s}"", ;"\r\n' for i, lang, text, s in texts))
    assert csv.Sniffer().sniff(open(f"{folder}/a.csv", newline="").read(), delimiters=",\t;|").delimiter == ","
    rows = delimited.read_delimited(spark, f"{folder}/a.csv").orderBy("row_no").collect()
    assert [(r.delimiter, *r.cells) for r in rows] == [(";", i, lang, text, f'"src{s}", ;') for i, lang, text, s in texts]
    assert delimited._row_sizes('1;2;"long\ntext', ";") == [3] and delimited._row_sizes('1;2;"long\ntext', ",") is None


def test_markdown_lines_equal_whole_files(spark, folder):
    r = random.Random(3)
    parts = ["## one", "## two  ", "### sub", "**bold**", "**b2** : ", "text", "  more text ", "| a | b |", "|---|---|", "| c | d |", "", " ", "<!-- page 3 -->",
             "## with <!-- page 2 -->", "#### four", "##no space", "line \ufffd", "x" * 500]
    for i in range(6):
        put(folder, f"f {i}.md", ("\r\n" if i % 2 else "\n").join(r.choice(parts) for _ in range(200)).encode() + b"\rlast")
    whole = units.markdown_units(corpus.read_markdown(spark, folder), mining.is_table_header)
    columns = ("source_file", "unit_no", "text", "heading_path", "preceding_text")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        lines = corpus.read_markdown_lines(spark, folder)
        got = sorted(tuple(x) for x in units.markdown_line_units(lines, mining.is_table_header, run=20).select(*columns).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(tuple(x) for x in whole.select(*columns).collect()) and len(got) > 500


def test_labelled_files_are_checked(spark, folder):
    good = put(folder, "g.csv", "text,cso_grade\n 글 ,C\n ,S\n".encode("utf-8-sig"))
    assert [(r.text, r.cso_grade) for r in delimited.read_labelled(spark, good).collect()] == [("글", "C")]
    with pytest.raises(ValueError):
        delimited.read_labelled(spark, put(folder, "m.csv", b"text\nx\n"))
    with pytest.raises(Exception, match="unknown grade"):
        delimited.read_labelled(spark, put(folder, "u.csv", b"text,cso_grade\nx,Q\n")).collect()


CONFIG = {"ai_tracks": {"strong_procedural": {"keywords": ["복구 절차", "카드 리셋", "전원 투입 순서"]}, "ambiguous_action": {"keywords": ["장애", "투입"]},
                        "operational_anchor": {"keywords": ["장비", "전원"]}, "s_business_sensitive": {"keywords": ["단가"]}},
          "weak": {"keywords": ["확인", "상태"]}}


def test_markdown_mining(spark, folder):
    put(folder, "운영 매뉴얼.md", ("## 장애 대응\n장애 발생 시 카드 리셋 후 복구 절차를 따르고 서버 10.1.2.3 상태를 확인한다\n"
                               "전면 LED 표시 상태 확인 바랍니다 모두\n문의는 담당자 메일 a.b@example.com 으로 보내 주세요\n## 목차\n긴 본문이 있어도 목차 아래에서는 모두 제외된다 카드 리셋\n").encode())
    put(folder, "k.json", json.dumps(CONFIG).encode())
    pack = corpus.read_keywords(spark, os.path.join(folder, "k.json"))
    assert pack == pack_from_config(CONFIG) and corpus.keyword_rows(spark, pack).count() == 10
    rows = flows.mined_candidates(corpus.read_markdown(spark, folder), pack).orderBy("unit_no").collect()
    first, second = rows
    assert first.candidateType == '["ai_procedural_sensitive","regex_identifier"]' and first.regexOnly == "false"
    # Two strong keywords, no anchor, two weak ones.
    assert (first.priorityScore, first.priorityBand, first.suggestedGrade) == (6.4, "high", "C")
    assert [r["kw"] for r in json.loads(first.candidateReason)] == ["복구 절차", "카드 리셋", "확인", "상태", "10.1.2.3"]
    assert second.regexOnly == "true" and second.suggestedGrade == "" and second.headingPath == "장애 대응"
    base = os.path.join(folder, "cand")
    sinks.write_candidates(flows.mined_candidates(corpus.read_markdown(spark, folder), pack), base)
    assert [spark.read.option("header", True).csv(f"{base}_{n}").count() for n in ("all", "ai", "regex")] == [2, 1, 2]


def item(ai, user, kind, i):
    return {"locationLabel": f"{i}쪽", "context": f"글 {i}", "aiGrade": ai, "userGrade": user, "fileType": kind, "sensitiveCategory": "AI_S", "reason": "r",
            "userId": None, "timestamp": 1779750000.0 + i, "isAgreement": user == ai, "isFalsePositive": user == "X"}


def test_feedback_days(spark, folder):
    put(folder, "feedback_2026-05-26.json", json.dumps([item("S", "X", "hwpx", i) for i in range(2)]).encode())
    put(folder, "feedback_2026-05-28.json", json.dumps([item("C", "X", "pdf", i) for i in range(9)]).encode())
    put(folder, "feedback_2026-05-29.json", b"[{broken")
    fb = feedback_files.read_feedback(spark, folder)
    r = FB.overall_stats(fb).first()
    assert (r.total, r.agreements, r.false_positives, r.mismatches, r.false_positive_rate) == (11, 0, 11, 11, 1.0)
    assert {x.label for x in FB.retrain_rows(fb).collect()} == {"O"}
    assert feedback_files.read_feedback(spark, folder, "2026-05-27", "2026-05-28").count() == 9
    assert [x.context for x in FB.latest(fb, "2026-05-28", 2).collect()] == ["글 7", "글 8"]
    empty = FB.overall_stats(fb.where("false")).first()
    assert empty.total == 0 and empty.agreement_rate is None
    assert FB.store_stats(fb.where("false")).first().agreement_rate == 0
    sinks.write_retrain_set(FB.retrain_rows(fb), os.path.join(folder, "rt"))
    assert spark.read.json(os.path.join(folder, "rt")).count() == 11


def test_feedback_stream_equals_batch(spark, folder):
    inbox = os.path.join(folder, "inbox")
    os.mkdir(inbox)
    for n in range(3):
        put(inbox, f"{n}.json", "\n".join(json.dumps({k: v for k, v in item("C", "CXQ"[i % 3], "pdf", i + 86400 * n).items() if not k.startswith("is")})
                                          for i in range(6)).encode())
    store, check = os.path.join(folder, "store"), os.path.join(folder, "check")
    for _ in range(2):  # the second run finds nothing new
        S.append_feedback(S.feedback_inbox(spark, inbox), store, check).awaitTermination()
    got = feedback_files.read_feedback_store(spark, store)
    assert got.count() == 12 and got.where("isFalsePositive").count() == 6 and got.select("feedback_date").distinct().count() == 3


def test_every_payload_is_stored_or_rejected_once(spark, folder):
    inbox, store, rejects, check = (os.path.join(folder, x) for x in ("inbox", "store", "rejects", "check"))
    os.mkdir(inbox)
    for n in range(4):
        payloads = [json.dumps({k: v for k, v in item("C", "CXQ"[i % 3], "pdf", i + 86400 * n).items() if not k.startswith("is")}) for i in range(6)]
        put(inbox, f"{n}.json", "\n".join([*payloads, "not json", '{"context": "no place", "userGrade": "C"}']).encode())
    S.store_feedback(S.payload_stream(spark, inbox, 2), store, rejects, check).awaitTermination()
    # A run that broke off: the last batch counts as not done and one of its folders is half written.
    done = sorted(int(f) for f in os.listdir(os.path.join(check, "commits")) if f.isdigit())
    os.remove(os.path.join(check, "commits", str(done[-1])))
    crc = os.path.join(check, "commits", f".{done[-1]}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    put(os.path.join(store, f"batch_id={done[-1]}"), "part-left-over.json", b'{"locationLabel": "twice"}')
    S.store_feedback(S.payload_stream(spark, inbox, 2), store, rejects, check).awaitTermination()
    stored, refused = spark.read.json(store), spark.read.json(rejects)
    assert stored.count() == 4 * 4 and stored.where("locationLabel = 'twice'").count() == 0 and len(done) > 1
    assert {x["error"]: x["count"] for x in refused.groupBy("error").count().collect()} == {
        "userGrade must be one of C, S, O, X": 8, "payload is not a JSON object of the expected types": 4, "locationLabel is required": 4}


def test_open_days_are_counted(spark, folder):
    """Days of the last feedback and feedback that arrives after later days."""
    base = 1_777_593_600  # 2026-05-01
    def arrive(name, days):
        with open(f"{folder}/in/{name}.json", "w") as f:
            for d in days:
                f.write(json.dumps({"locationLabel": "a", "context": "b", "aiGrade": "C", "userGrade": "C" if d % 2 else "X", "timestamp": base + d * 86400.0}) + "\n")

    os.mkdir(f"{folder}/in")
    for name, days in (("a", [0, 1, 1, 9]), ("b", [0, 9, 9])):
        arrive(name, days)
        S.store_daily_counts(S.feedback_inbox(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/check").awaitTermination()
    got = {tuple(r) for r in S.read_daily_counts(spark, f"{folder}/out").collect()}
    assert got == {("2026-05-01", 2, 0, 2), ("2026-05-02", 2, 2, 0), ("2026-05-10", 3, 3, 0)}


def test_streams_of_one_file_are_spread(spark, folder):
    from veilspark.sources.tables import spread

    spark.range(1000).coalesce(1).write.parquet(f"{folder}/t")
    there = spark.read.parquet(f"{folder}/t")
    arriving = spread(spark.readStream.schema(there.schema).parquet(f"{folder}/t"), "id", there)
    arriving.withColumn("task", F.spark_partition_id()).writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{folder}/out")
    assert found.count() == 1000 and found.select("task").distinct().count() == 8


def test_parts_of_a_spread_table_grow_with_it(spark, folder, monkeypatch):
    from veilspark.sources import tables

    spark.range(100_000).coalesce(1).write.parquet(f"{folder}/t")
    there = spark.read.parquet(f"{folder}/t")
    assert tables.spread(there, "id").rdd.getNumPartitions() == 8
    monkeypatch.setattr(tables, "PART", 1 << 14)
    assert tables.spread(there, "id").rdd.getNumPartitions() > 8


def test_routing(spark):
    files = spark.createDataFrame([("/a/b.DOCX",), ("/a.v1/readme",), ("x.csv",)], "path string")
    ok, bad = routing.split_supported(files)
    assert {(r.file_type, r.apply_mode) for r in ok.collect()} == {("docx", "guide"), ("csv", "applied")} and bad.count() == 1


def test_result_documents(spark):
    docs = spark.createDataFrame([(1, "/in/a.csv", "csv")], "doc_id long, path string, file_type string")
    rows = spark.createDataFrame([(1, 1, ["번호"]), (1, 2, ["010-1234-5678"])], "doc_id long, row_no int, cells array<string>")
    out = flows.applied_cells(units.cell_units(rows, F.col("cells"), F.array(F.lit("번호")), F.col("row_no")))
    r = json.loads(sinks.result_documents(docs, out.items, out.reviews, out.summary).first().result)
    assert r["success"] and r["applyMode"] == "applied" and r["metadata"]["originalFilename"] == "a.csv"
    assert r["autoResults"][0]["appliedText"] == "*" * 13 and r["autoResults"][0]["locationMeta"]["rowNo"] == 2
    assert r["summary"]["appliedLocations"] == 1 and r["reviewTargets"] == []
    assert list(r) == ["success", "fileType", "applyMode", "inputFilePath", "outputFilePath", "autoResults", "reviewTargets", "warnings", "summary", "metadata"]
    assert r["outputFilePath"] is None and r["metadata"]["fileSize"] is None
    assert set(r["autoResults"][0]) == {"locationLabel", "locationMeta", "label", "action", "originalText", "appliedText", "status", "appliedTargetCount",
                                        "skippedTargetCount", "warnings", "grade", "source"}
    assert None not in r["autoResults"][0]["locationMeta"].values()


def test_result_of_a_document_without_hits(spark):
    docs = spark.createDataFrame([(1, "/in/a \"q\".pdf", "pdf"), (2, "/in/b.xyz", None)], "doc_id long, path string, file_type string")
    rows = spark.createDataFrame([(9, 1, ["번호"])], "doc_id long, row_no int, cells array<string>")
    out = flows.applied_cells(units.cell_units(rows, F.col("cells"), F.array(F.lit("번호")), F.col("row_no")))
    warned = spark.createDataFrame([(1, "b"), (1, "a\n")], "doc_id long, warning string")
    got = {r.doc_id: json.loads(r.result) for r in sinks.result_documents(docs, out.items, out.reviews, out.summary, warned).collect()}
    assert got[1]["warnings"] == ["a\n", "b"] and got[1]["metadata"]["originalFilename"] == 'a "q".pdf' and got[1]["autoResults"] == []
    assert set(got[1]["summary"].values()) == {0} and len(got[1]["summary"]) == 7 and got[2]["fileType"] is None and got[2]["applyMode"] is None
