"""Text units: rows with a text and a location.

Texts that sit whole in one row (files, documents, pages) are unnested inside the row.  Element tables
(one row per paragraph, shape or cell, produced by an upstream file reader) are numbered with the
run-wise helpers of ``functions.running``.

Element columns: doc_id, seq, kind, section_no, slide_no, group_depth, group_shape_no, shape_no,
host_seq, table_no, row_no, col_no, sheet_name, cell_ref, cell_type, bbox, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import location as L
from veilspark.functions.running import RUN, last_before, numbered, with_runs
from veilspark.functions.text import SPACE, SPACE_CLASS, is_blank, let, lines, strip, unify_line_ends

UNIT = ["doc_id", "unit_no", "text", "location_label", "loc"]


def aliased_units(records: DataFrame) -> DataFrame:
    """Unit records with camelCase or snake_case columns to units; missing label and location get
    defaults."""
    def pick(*names: str) -> list[Column]:
        return [F.col(n) for n in names if n in records.columns]

    label = F.coalesce(
        *[F.when(c != "", c) for c in pick("locationLabel")], *pick("location_label"), F.lit("위치 정보 없음"))
    loc = F.coalesce(*pick("locationMeta", "location_meta", "loc"), L.no_location())
    keys = [c for c in ("doc_id", "unit_no") if c in records.columns]
    return records.select(*keys, "text", label.alias("location_label"), loc.alias("loc"))


# --- delimited tables and sheets ---------------------------------------------------------------------

def cell_units(rows: DataFrame, cells: Column, headers: Column, row_no: Column) -> DataFrame:
    """Cells of delimited rows as units.

    ``cells`` is the row's array of cells, ``headers`` the array of the file's first row and ``row_no``
    1-based.  Blank cells are dropped; a column without a header is called ``{n}열``."""
    # Headers are paired with the cells inside the row, so that no exploded row drags them along.
    pairs = F.transform(cells, lambda c, i: F.struct(c.alias("text"), F.get(headers, i).alias("header")))
    exploded = rows.select(
        "doc_id", row_no.cast("int").alias("row_no"), F.posexplode(pairs).alias("pos", "cell")
    ).select("doc_id", "row_no", "pos", "cell.*")
    col_no = F.col("pos") + 1
    header = F.coalesce("header", F.concat(col_no.cast("string"), F.lit("열")))
    return exploded.where(~is_blank(F.coalesce("text", F.lit("")))).select(
        "doc_id",
        (F.col("row_no").cast("bigint") * F.lit(1 << 20) + col_no).alias("unit_no"),
        "text",
        L.csv_label(F.col("row_no"), col_no, header, F.col("text")).alias("location_label"),
        L.location(fileType=F.lit("csv"), rowNo=F.col("row_no"), colNo=col_no, headerName=header).alias("loc"),
    )


def column_cell_units(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cells of a Spark table as units: the column name serves as header, ``key`` (0-based, unique)
    gives the row number, and row 1 would be the header line."""
    cells = F.array(*[F.col(c).cast("string") for c in columns])
    rows = table.withColumn("doc_id", F.lit(0).cast("bigint"))
    return cell_units(rows, cells, F.array(*[F.lit(c) for c in columns]), F.col(key) + 2)


def sheet_units(elements: DataFrame) -> DataFrame:
    """Spreadsheet cells: only non-blank strings."""
    return elements.where((F.col("cell_type") == "string") & ~is_blank(F.col("text"))).select(
        "doc_id", F.col("seq").alias("unit_no"), "text",
        L.sheet_label(F.col("sheet_name"), F.col("cell_ref")).alias("location_label"),
        L.location(fileType=F.lit("xlsx"), sheetName=F.col("sheet_name"), cellRef=F.col("cell_ref")).alias("loc"),
    )


# --- paragraph documents ------------------------------------------------------------------------------

def _with_label(units: DataFrame, file_type: str, preceding: Column | None = None) -> DataFrame:
    return units.withColumn(
        "location_label", L.unit_label(file_type, F.col("loc"), F.col("text"), preceding))


def paragraph_units(elements: DataFrame) -> DataFrame:
    """Body paragraphs, then table-cell paragraphs.  Blank ones are dropped but keep their number;
    text repeated by merged cells is kept."""
    body = numbered(elements.where("kind = 'body'"), ["doc_id"], "seq", "paragraph_no").select(
        "doc_id", F.lit(0).alias("part"), "seq", "text",
        L.location(fileType=F.lit("docx"), section=F.lit("body"), paragraphNo=F.col("paragraph_no")).alias("loc"))
    cells = numbered(
        elements.where("kind = 'table_cell'"), ["doc_id", "table_no", "row_no", "col_no"], "seq", "paragraph_no"
    ).select(
        "doc_id", F.lit(1).alias("part"), "seq", "text",
        L.location(fileType=F.lit("docx"), section=F.lit("table_cell"), paragraphNo=F.col("paragraph_no"),
                   tableNo=F.col("table_no"), rowNo=F.col("row_no"), colNo=F.col("col_no")).alias("loc"))
    out = body.unionByName(cells).where(~is_blank(F.col("text")))
    # Cells come after the whole body, whatever their sequence number.
    out = out.withColumn("unit_no", F.col("part").cast("bigint") * F.lit(1 << 40) + F.col("seq"))
    return _with_label(out, "docx").select(*UNIT)


def slide_units(elements: DataFrame) -> DataFrame:
    """Slides: shape texts, table cells, one level of groups, notes last.  Tables are counted per slide
    across groups; deeper groups are dropped."""
    flat = elements.where(
        F.col("kind").isin("shape_text", "table_cell", "notes") & (F.coalesce("group_depth", F.lit(0)) <= 1))
    grouped = F.coalesce("group_depth", F.lit(0)) == 1
    starts = (F.col("kind") == "table_cell") & F.col("first_of_table")
    marked = flat.withColumn("first_of_table", F.coalesce("first_of_table", F.lit(False)))
    counted = numbered(marked, ["doc_id", "slide_no"], "seq", "table_index", counts=starts)
    para_keys = ["doc_id", "slide_no", "kind", "group_shape_no", "shape_no", "row_no", "col_no"]
    counted = numbered(counted, para_keys, "seq", "paragraph_no")
    section = F.when(grouped, F.concat(F.lit("group_"), F.col("kind"))).otherwise(F.col("kind"))
    loc = L.location(
        fileType=F.lit("pptx"), slideNo=F.col("slide_no"), section=section, paragraphNo=F.col("paragraph_no"),
        shapeNo=F.when(F.col("kind") != "notes", F.col("shape_no")), rowNo=F.col("row_no"), colNo=F.col("col_no"),
        groupShapeNo=F.when(grouped, F.col("group_shape_no")),
        tableIndex=F.when(F.col("kind") == "table_cell", F.col("table_index")))
    # Order: slide, then notes after everything else of the slide, then sequence.
    unit_no = (
        F.col("slide_no").cast("bigint") * F.lit(1 << 42)
        + F.when(F.col("kind") == "notes", F.lit(1 << 41)).otherwise(F.lit(0)) + F.col("seq"))
    out = counted.where(~is_blank(F.col("text"))).select(
        "doc_id", unit_no.alias("unit_no"), "text", loc.alias("loc"))
    return _with_label(out, "pptx").select(*UNIT)


def section_units(elements: DataFrame) -> DataFrame:
    """Section documents: body paragraphs followed by the cells of their tables.  A cell's label also
    names the last non-blank body text before the paragraph that holds its table."""
    body = numbered(elements.where("kind = 'body'"), ["doc_id", "section_no"], "seq", "paragraph_no")
    body = last_before(
        body, ["doc_id", "section_no"], "seq",
        F.when(~is_blank(F.col("text")), strip(F.col("text"))), "preceding_text")
    hosts = body.select(
        "doc_id", "section_no", F.col("seq").alias("host_seq"), "paragraph_no", "preceding_text")
    cell_keys = ["doc_id", "section_no", "host_seq", "table_no", "row_no", "col_no"]
    cells = numbered(elements.where("kind = 'table_cell'"), cell_keys, "seq", "cell_paragraph_no").join(
        hosts, ["doc_id", "section_no", "host_seq"])
    body_units = body.select(
        "doc_id", "section_no", "seq", "text", F.lit(None).cast("string").alias("preceding_text"),
        L.location(fileType=F.lit("hwpx"), sectionNo=F.col("section_no"), section=F.lit("body"),
                   paragraphNo=F.col("paragraph_no")).alias("loc"))
    table_units = cells.select(
        "doc_id", "section_no", "seq", "text", "preceding_text",
        L.location(fileType=F.lit("hwpx"), sectionNo=F.col("section_no"), section=F.lit("table_cell"),
                   paragraphNo=F.col("paragraph_no"), tableIndex=F.col("table_no"), rowNo=F.col("row_no"),
                   colNo=F.col("col_no"), cellParagraphNo=F.col("cell_paragraph_no")).alias("loc"))
    out = body_units.unionByName(table_units).where(~is_blank(F.col("text"))).withColumn(
        "unit_no", F.col("section_no").cast("bigint") * F.lit(1 << 42) + F.col("seq"))
    return _with_label(out, "hwpx", F.col("preceding_text")).select(*UNIT, "preceding_text")


# --- page lines -----------------------------------------------------------------------------------------

def page_line_units(
    pages: DataFrame, doc_id: Column, page_no: Column, text: Column, label: bool = True
) -> DataFrame:
    """Lines of pages: numbered from 0 before blank ones are dropped."""
    exploded = pages.select(
        doc_id.alias("doc_id"), page_no.cast("int").alias("page_no"), F.posexplode(lines(text)).alias("line_no", "text"))
    out = exploded.where(~is_blank(F.col("text"))).select(
        "doc_id", (F.col("page_no").cast("bigint") * F.lit(1 << 32) + F.col("line_no")).alias("unit_no"), "text",
        L.location(fileType=F.lit("pdf"), pageNo=F.col("page_no"), section=F.lit("text_line"),
                   lineNo=F.col("line_no")).alias("loc"))
    if not label:
        return out.withColumn("location_label", F.lit(None).cast("string")).select(*UNIT)
    return _with_label(out, "pdf").select(*UNIT)


def line_element_units(elements: DataFrame) -> DataFrame:
    """Page lines that already are rows (page_no, line_no, bbox with x0, top, x1, bottom); an incomplete
    box counts as none."""
    b = F.col("bbox")
    box = F.when(
        b["x0"].isNotNull() & b["top"].isNotNull() & b["x1"].isNotNull() & b["bottom"].isNotNull(),
        F.array(b["x0"], b["top"], b["x1"], b["bottom"]))
    out = elements.where("kind = 'page_line'").where(~is_blank(F.col("text"))).select(
        "doc_id", F.col("seq").alias("unit_no"), "text",
        L.location(fileType=F.lit("pdf"), pageNo=F.col("page_no"), section=F.lit("text_line"),
                   lineNo=F.col("line_no"), bbox=box).alias("loc"))
    return _with_label(out, "pdf").select(*UNIT)


def extraction_stats(pages: DataFrame, doc_id: Column, page_no: Column, text: Column) -> DataFrame:
    """Per document: pages, non-blank lines, their characters, and the pages without any."""
    kept = F.filter(lines(text), lambda x: ~is_blank(x))
    per_page = pages.select(doc_id.alias("doc_id"), page_no.alias("page_no"), kept.alias("kept")).select(
        "doc_id", "page_no", F.size("kept").alias("n"),
        F.aggregate("kept", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("chars"))
    return per_page.groupBy("doc_id").agg(
        F.countDistinct("page_no").alias("page_count"),
        F.sum("n").alias("total_lines"),
        F.sum("chars").alias("total_chars"),
        F.sort_array(F.collect_list(F.when(F.col("chars") == 0, F.col("page_no")))).alias("empty_pages"),
    )


# --- Markdown ----------------------------------------------------------------------------------------

# Markdown boundaries.
_WS = f"[{SPACE_CLASS}&&[^\\n]]"
_H2 = rf"##{_WS}+([^\n]+)"
_H3 = rf"###{_WS}+([^\n]+)"
_BOLD = rf"\*\*([^*\n]+)\*\*{_WS}*[：:]?{_WS}*"
_PAGE = rf"<!--{_WS}*page{_WS}+\d+{_WS}*-->"
_SP = f"{SPACE}*"
TABLE_RULE = rf"^{_SP}\|?{_SP}:?-{{3,}}:?{_SP}(\|{_SP}:?-{{3,}}:?{_SP})+\|?{_SP}$"


def is_table_row(line: Column) -> Column:
    s = strip(line)
    return s.startswith("|") & s.endswith("|") & (F.length(F.regexp_replace(s, r"[^|]", "")) >= 2)


def table_row_text(line: Column) -> Column:
    """Non-empty cells joined with `` / ``."""
    inner = F.regexp_replace(strip(line), r"^\|+|\|+$", "")
    cells = F.transform(F.split(inner, r"\|", -1), strip)
    return F.array_join(F.filter(cells, lambda c: c != ""), " / ")


def _sections(content: Column, page: str, per_section) -> Column:
    """Nest the text by heading level and map each innermost section (body, heading path).

    A second-level heading ends the third-level and bold titles above it and a third-level heading the
    bold title, which is just what cutting level by level yields: no running state, no window.
    A line with a page comment never is a heading."""
    no_page = rf"(?![^\n]*{page})"

    def cut_before(text: Column, heading: str) -> Column:
        return F.split(text, rf"(?mU)^(?={no_page}{heading}$)", -1)

    def title(section: Column, heading: str) -> Column:
        return strip(F.regexp_extract(section, rf"(?U)\A{no_page}{heading}(?:\n|\z)", 1))

    def body(section: Column, heading: str) -> Column:
        return F.regexp_replace(section, rf"(?U)\A{no_page}{heading}(?:\n|\z)", "")

    def in_h2(s2: Column) -> Column:
        def in_h3(s3: Column) -> Column:
            def in_bold(s4: Column) -> Column:
                titles = F.array(title(s2, _H2), title(s3, _H3), title(s4, _BOLD))
                path = F.array_join(F.filter(titles, lambda t: t != ""), " > ")
                return let(path, lambda p: per_section(body(s4, _BOLD), p))

            return F.flatten(F.transform(cut_before(body(s3, _H3), _BOLD), in_bold))

        return F.flatten(F.transform(cut_before(body(s2, _H2), _H3), in_h3))

    return let(unify_line_ends(content), lambda whole: F.flatten(F.transform(cut_before(whole, _H2), in_h2)))


def _unnest(files: DataFrame, units: Column, content: str) -> DataFrame:
    """One row per unit with the text of the unit before it (first 400 characters)."""
    keep = [c for c in files.columns if c != content]
    held = files.select(*keep, units.alias("_units"))
    paired = F.transform("_units", lambda u, i: F.struct(
        u["text"].alias("text"), u["path"].alias("heading_path"),
        F.substring(F.coalesce(F.get("_units", i - 1)["text"], F.lit("")), 1, 400).alias("preceding_text")))
    return held.select(*keep, F.posexplode(paired).alias("unit_no", "u")).select(*keep, "unit_no", "u.*")


def markdown_units(files: DataFrame, is_header, content: str = "content") -> DataFrame:
    """Lines and table rows of Markdown texts with heading path and preceding unit.

    ``is_header`` is the Column function that tells table header rows.  Everything happens inside the
    file's row; unit numbers follow the text."""
    page = rf"(?i:{_PAGE})"

    def per_section(body: Column, path: Column) -> Column:
        kept = F.filter(
            F.split(body, "\n", -1),
            lambda x: ~is_blank(x) & ~x.rlike(f"(?U){page}") & ~(is_table_row(x) & strip(x).rlike(TABLE_RULE)))
        units = F.transform(kept, lambda x: F.struct(
            F.when(is_table_row(x), table_row_text(x)).otherwise(strip(x)).alias("text"),
            is_table_row(x).alias("row"), path.alias("path")))
        return F.filter(units, lambda u: (u["text"] != "") & ~(u["row"] & is_header(u["text"])))

    return _unnest(files, _sections(F.col(content), page, per_section), content)


def markdown_line_units(lines: DataFrame, is_header, file: str = "source_file", seq: str = "line_no", text: str = "text", run: int = RUN) -> DataFrame:
    """The units of ``markdown_units`` from a table of lines: a file of any length spreads over many tasks.

    (file, unit_no, text, heading_path, preceding_text).  A file's lines are cut into runs.  What a run leaves to those after
    it is one small row: its last heading of each level with its place, its last unit's beginning and its number of units.
    Rows of such a kind add up in order, so each run gets what came before it and is worked on by itself."""
    t = F.col(text)
    page = t.rlike(rf"(?U)(?i:{_PAGE})")
    names = {"_h2": _H2, "_h3": _H3, "_bold": _BOLD}
    marks = {n: F.when(~page & t.rlike(rf"(?U)\A{h}\z"), F.struct(F.col(seq).alias("at"), strip(F.regexp_extract(t, rf"(?U)\A{h}\z", 1)).alias("title")))
             for n, h in names.items()}
    row = is_table_row(t)
    said = F.when(row, table_row_text(t)).otherwise(strip(t))
    heading = F.col("_h2").isNotNull() | F.col("_h3").isNotNull() | F.col("_bold").isNotNull()
    rule = row & strip(t).rlike(TABLE_RULE)
    cut = with_runs(lines, [file], seq, run).withColumns(marks).withColumn("_unit", F.when(
        ~heading & ~is_blank(t) & ~page & ~rule & (said != "") & ~(row & is_header(said)), said))
    earlier = Window.partitionBy("_k").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    local = Window.partitionBy("_k", "_run").orderBy(seq)
    upto, before = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(Window.unboundedPreceding, -1)
    first = F.substring("_unit", 1, 400)
    left = cut.groupBy("_k", "_run").agg(
        *[F.max(n).alias(n) for n in names], F.max_by(first, F.when(F.col("_unit").isNotNull(), F.col(seq))).alias("_said"), F.count("_unit").alias("_n"))
    left = left.select(
        "_k", "_run", *[F.max(n).over(earlier).alias(f"{n}_before") for n in names],
        F.last("_said", ignorenulls=True).over(earlier).alias("_said_before"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n_before"))
    done = cut.withColumns({
        **{n: F.last(n, ignorenulls=True).over(upto) for n in names}, "_said": F.last(first, ignorenulls=True).over(before), "_n": F.count("_unit").over(before)})
    done = done.where(F.col("_unit").isNotNull()).join(left, ["_k", "_run"])
    h2, h3, bold = (F.coalesce(n, f"{n}_before") for n in names)
    none = F.lit(-1).cast("bigint")
    at2, at3 = F.coalesce(h2["at"], none), F.coalesce(h3["at"], none)
    titles = F.array(h2["title"], F.when(at3 > at2, h3["title"]), F.when(bold["at"] > F.greatest(at2, at3), bold["title"]))
    return done.select(
        file, (F.col("_n_before") + F.col("_n")).cast("int").alias("unit_no"), F.col("_unit").alias("text"),
        F.array_join(F.filter(titles, lambda x: x.isNotNull() & (x != "")), " > ").alias("heading_path"),
        F.coalesce("_said", "_said_before", F.lit("")).alias("preceding_text"))


def markdown_blocks(files: DataFrame, content: str = "content") -> DataFrame:
    """Older units: everything between two boundaries is one block."""
    def per_section(body: Column, path: Column) -> Column:
        parts = F.split(body, rf"(?mU)^[^\n]*{_PAGE}[^\n]*$", -1)
        return F.transform(
            F.filter(F.transform(parts, strip), lambda b: b != ""),
            lambda b: F.struct(b.alias("text"), path.alias("path")))

    return _unnest(files, _sections(F.col(content), _PAGE, per_section), content)


def unit_id(source_file: Column, heading_path: Column, text: Column) -> Column:
    """File stem (20 characters, spaces to ``_``) and a digest of file, heading path and text."""
    stem = F.regexp_replace(source_file, r"(?<=.)\.[^.]*$", "")
    return F.concat(
        F.replace(F.left(stem, F.lit(20)), F.lit(" "), F.lit("_")), F.lit("_"),
        F.left(F.sha2(F.concat_ws("|", source_file, heading_path, text), 256), F.lit(10)))
