from pyspark.sql import functions as F

from veilspark.functions import location as L
from veilspark.functions.running import last_before, numbered, ranked, smallest_by_hash, with_runs
from veilspark.operators import units as U
from veilspark.operators.mining import is_table_header

ELEMENT = ("doc_id long, seq long, kind string, section_no int, slide_no int, group_depth int, group_shape_no int, shape_no int, host_seq long, "
           "table_no int, row_no int, col_no int, first_of_table boolean, text string")


def elements(spark, *rows):
    names = [c.split()[0] for c in ELEMENT.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ELEMENT)


def test_running_helpers_do_not_depend_on_the_run_length(spark):
    df = spark.createDataFrame([(g, i, None if i % 3 else f"v{i}") for g in (1, None) for i in range(50)], "g int, seq long, v string")
    for run in (4, 1000):
        rows = numbered(df, ["g"], "seq", "n", counts=F.col("v").isNotNull(), run=run).collect()
        assert len(rows) == 100 and all(r.n == r.seq // 3 for r in rows)
        rows = last_before(df, ["g"], "seq", F.col("v"), "before", run=run).collect()
        assert all(r.before == (f"v{(r.seq - 1) // 3 * 3}" if r.seq else None) for r in rows)


def test_runs_hold_rows_not_values(spark):
    """Bursts, gaps and timestamps: runs are cut by numbers of rows."""
    rows = [("a", 10**15 + i) for i in range(3000)] + [("a", 5), ("a", 7 * 10**16)] + [("b", i * 10**9) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, seq long").repartition(5).withColumn("ts", F.timestamp_micros("seq"))
    for seq in ("seq", "ts"):
        cut = with_runs(df, ["g"], seq, run=100)
        sizes = {(r.g, r._run): r["count"] for r in cut.groupBy("g", "_run").count().collect()}
        assert sum(g == "a" for g, _ in sizes) > 100 and max(n for (g, _), n in sizes.items() if g == "a") < 200
        assert [n for (g, _), n in sizes.items() if g == "b"] == [40]
        got = numbered(df, ["g"], seq, "n", run=100, kind="bigint").collect()
        for g in ("a", "b"):
            assert [r.n for r in sorted((r for r in got if r.g == g), key=lambda r: r.seq)] == list(range(sum(r[0] == g for r in rows)))


def test_ranks_are_exact_with_any_bounds(spark):
    rows = [(i % 7, None if i % 5 == 0 else f"n{i % 50:02}", i) for i in range(700)]
    df = spark.createDataFrame(rows, "score int, name string, no long").repartition(6)
    want = {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or "", r[2])), 1)}
    for sample in (0, 3, 500):
        got = ranked(df, [-F.col("score"), F.col("name"), F.col("no")], parts=16, sample=sample).collect()
        assert {r.no: r["rank"] for r in got} == want
    assert ranked(df.limit(0), [F.col("no")]).count() == 0


def test_smallest_by_hash_takes_exact_quotas(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "C").otherwise("S").alias("label"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    out = smallest_by_hash(df, "h", F.floor(F.col("_total") * 0.2), by="label", domain=("C", "S", "O"), digits=1)
    got = {r.label: (r.n, r.c) for r in out.groupBy("label").agg(F.count("*").alias("n"), F.count_if("chosen").alias("c")).collect()}
    assert got == {"C": (334, 66), "S": (666, 133)}
    top = {r.id for r in out.where("chosen and label = 'C'").collect()}
    assert top == {r.id for r in df.where("label = 'C'").orderBy("h").limit(66).collect()}


def test_csv_labels(spark):
    rows = spark.createDataFrame([(1, 1, ["이름", "번호"]), (1, 2, ["김", "  ", "더"])], "doc_id long, row_no int, cells array<string>")
    u = U.cell_units(rows, F.col("cells"), F.array(F.lit("이름"), F.lit("번호")), F.col("row_no")).orderBy("unit_no").collect()
    assert [r.location_label for r in u] == ["헤더 1열 (이름)", "헤더 2열 (번호)", "2행 이름열", "2행 3열열"]
    assert [(r["loc"].rowNo, r["loc"].colNo, r["loc"].headerName) for r in u][3] == (2, 3, "3열")


def test_paragraphs_keep_their_number_and_cells_come_last(spark):
    e = elements(spark, {"doc_id": 1, "seq": 0, "kind": "body", "text": " "}, {"doc_id": 1, "seq": 1, "kind": "table_cell", "table_no": 0, "row_no": 0, "col_no": 1, "text": ""},
                 {"doc_id": 1, "seq": 2, "kind": "table_cell", "table_no": 0, "row_no": 0, "col_no": 1, "text": "셀"},
                 {"doc_id": 1, "seq": 3, "kind": "body", "text": "담당자 김도윤의 이메일은 test@example.com입니다."})
    a, b = U.paragraph_units(e).orderBy("unit_no").collect()
    assert a.location_label == "본문 2번째 문단: " + "담당자 김도윤의 이메일은 test@example.com입니다."[:30] + "..."
    assert b.location_label == "표 1번 1행 2열 2번째 문단: 셀" and b["loc"].paragraphNo == 1


def test_slide_tables_are_counted_across_groups(spark):
    def cell(seq, shape, first, depth=0, group=None):
        return {"doc_id": 1, "seq": seq, "slide_no": 0, "kind": "table_cell", "shape_no": shape, "row_no": 0, "col_no": 0, "group_depth": depth,
                "group_shape_no": group, "first_of_table": first, "text": f"t{seq}"}

    e = elements(spark, cell(0, 0, True), cell(1, 0, True, 1, 1), cell(2, 9, True, 2, 1), cell(3, 2, True),
                 {"doc_id": 1, "seq": -1, "slide_no": 0, "kind": "notes", "text": "노트"})
    got = [(r.location_label, r["loc"].section) for r in U.slide_units(e).orderBy("unit_no").collect()]
    assert got == [("1번 슬라이드 표 1번 1행 1열: t0", "table_cell"), ("1번 슬라이드 (그룹 내부) 표 2번 1행 1열: t1", "group_table_cell"),
                   ("1번 슬라이드 표 3번 1행 1열: t3", "table_cell"), ("1번 슬라이드 발표자 노트: 노트", "notes")]


def test_section_cells_name_the_text_before(spark):
    def cell(seq, host, text):
        return {"doc_id": 1, "seq": seq, "section_no": 0, "kind": "table_cell", "host_seq": host, "table_no": 0, "row_no": 0, "col_no": 0, "text": text}

    e = elements(spark, {"doc_id": 1, "seq": 0, "section_no": 0, "kind": "body", "text": ""}, cell(1, 0, "첫"),
                 {"doc_id": 1, "seq": 2, "section_no": 0, "kind": "body", "text": " 앞에 있는 본문입니다 "}, {"doc_id": 1, "seq": 3, "section_no": 0, "kind": "body", "text": "  "},
                 {"doc_id": 1, "seq": 4, "section_no": 0, "kind": "body", "text": "주인"}, cell(5, 4, "둘"))
    rows = {r.text: r for r in U.section_units(e).collect()}
    assert rows["첫"].preceding_text is None and rows["첫"].location_label == "1번 본문 1번째 문단 표 1번 1행 1열: 첫"
    assert rows["둘"].location_label.endswith("둘 (앞 문단: 앞에 있는 본문입니다)")


def test_incomplete_boxes_count_as_none(spark):
    e = spark.createDataFrame(
        [(1, 0, "page_line", 0, 0, (1.0, 2.0, 3.0, 4.0), "가"), (1, 1, "page_line", 0, 1, (1.0, None, 3.0, 4.0), "나")],
        "doc_id long, seq long, kind string, page_no int, line_no int, bbox struct<x0:double,top:double,x1:double,bottom:double>, text string")
    assert [r["loc"].bbox for r in U.line_element_units(e).orderBy("unit_no").collect()] == [[1.0, 2.0, 3.0, 4.0], None]


def test_markdown_headings_reset_and_rows(spark):
    text = "\r\n".join(["머리 전", "## 장", "### 절", "**소제목** ：", "본문 하나", "### 다음 절", "본문 둘", "## 새 장 <!-- page 2 -->", "본문 셋", "##  ", "#### 그냥",
                        "| 구분 | 내용 | 값 |", "|---|---|", "| 가 |  | 나 |", "<!-- PAGE 3 -->", "|", "## 끝", "마지막\x0b줄"])
    files = spark.createDataFrame([("a.md", text)], "source_file string, content string")
    u = U.markdown_units(files, is_table_header).orderBy("unit_no").collect()
    assert [(r.text, r.heading_path) for r in u] == [
        ("머리 전", ""), ("본문 하나", "장 > 절 > 소제목"), ("본문 둘", "장 > 다음 절"), ("본문 셋", "장 > 다음 절"), ("#### 그냥", ""), ("가 / 나", ""), ("|", ""),
        ("마지막", "끝"), ("줄", "끝")]
    assert [r.preceding_text for r in u][:3] == ["", "머리 전", "본문 하나"]
    blocks = U.markdown_blocks(files).orderBy("unit_no").collect()
    assert [r.text for r in blocks][-1] == "마지막\n줄" and blocks[0].text == "머리 전"


def test_unit_id_and_aliases(spark):
    import hashlib

    df = spark.createDataFrame([("운영 매뉴얼.v2.md", "장", "글", None, "위")], "f string, h string, text string, locationLabel string, location_label string")
    digest = hashlib.sha256("운영 매뉴얼.v2.md|장|글".encode()).hexdigest()[:10]
    assert df.select(U.unit_id(F.col("f"), F.col("h"), F.col("text"))).first()[0] == f"운영_매뉴얼.v2_{digest}"
    assert U.aliased_units(df).first().location_label == "위"
    assert U.aliased_units(df.drop("location_label")).first().location_label == "위치 정보 없음"


def test_guide_key_needs_its_fields(spark):
    df = spark.range(1).select(
        L.guide_key("pptx", L.location(section=F.lit("notes"), slideNo=F.lit(1), paragraphNo=F.lit(2))).alias("a"),
        L.guide_key("hwpx", L.location(section=F.lit("table_cell"), sectionNo=F.lit(0), paragraphNo=F.lit(2), rowNo=F.lit(1))).alias("b"),
        L.guide_gap("hwpx", L.location(section=F.lit("table_cell"), sectionNo=F.lit(0), paragraphNo=F.lit(2), rowNo=F.lit(1)), F.lit("x")).alias("c"))
    r = df.first()
    assert r.a == "notes, 1, 2" and r.b is None and r.c.message.endswith("missing=['tableIndex', 'colNo', 'cellParagraphNo']")
