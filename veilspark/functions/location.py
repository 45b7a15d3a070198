"""Locations: one superset struct with nullable fields, its labels and its grouping keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.text import first_chars, is_blank, label_with_context, strip

# The location fields of all file types.
FIELDS: dict[str, str] = {
    "fileType": "string", "section": "string", "sheetName": "string", "cellRef": "string",
    "rowNo": "int", "colNo": "int", "headerName": "string", "paragraphNo": "int", "tableNo": "int",
    "tableIndex": "int", "cellParagraphNo": "int", "slideNo": "int", "shapeNo": "int",
    "groupShapeNo": "int", "sectionNo": "int", "pageNo": "int", "lineNo": "int",
    "bbox": "array<double>",
}
LOC = "struct<" + ",".join(f"{n}:{t}" for n, t in FIELDS.items()) + ">"

GUIDE_SECTIONS = {
    "docx": ("body", "table_cell"),
    "pptx": ("shape_text", "table_cell", "notes", "group_shape_text", "group_table_cell"),
    "hwpx": ("body", "table_cell"),
    "pdf": ("text_line",),
}


def location(**given: Column) -> Column:
    """A location struct; fields not given are null."""
    unknown = set(given) - set(FIELDS)
    if unknown:
        raise ValueError(f"unknown location fields: {sorted(unknown)}")
    return F.struct(
        *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()]
    )


def no_location() -> Column:
    return F.lit(None).cast(LOC)


def _one_based(c: Column) -> Column:
    return F.coalesce((c + 1).cast("string"), F.lit("?"))


def csv_label(row_no: Column, col_no: Column, header: Column, text: Column) -> Column:
    return F.when(
        row_no == 1, F.concat(F.lit("헤더 "), col_no.cast("string"), F.lit("열 ("), text, F.lit(")"))
    ).otherwise(F.concat(row_no.cast("string"), F.lit("행 "), header, F.lit("열")))


def sheet_label(sheet: Column, cell: Column) -> Column:
    return F.concat_ws(" ", sheet, cell)


def docx_base_label(loc: Column) -> Column:
    para = (loc["paragraphNo"] + 1).cast("string")
    cell = F.concat(
        F.lit("표 "), (F.coalesce(loc["tableNo"], F.lit(0)) + 1).cast("string"), F.lit("번 "),
        (F.coalesce(loc["rowNo"], F.lit(0)) + 1).cast("string"), F.lit("행 "),
        (F.coalesce(loc["colNo"], F.lit(0)) + 1).cast("string"), F.lit("열"),
        F.when(loc["paragraphNo"] > 0, F.concat(F.lit(" "), para, F.lit("번째 문단"))).otherwise(""),
    )
    return F.when(loc["section"] == "table_cell", cell).otherwise(
        F.concat(F.lit("본문 "), para, F.lit("번째 문단"))
    )


def pptx_base_label(loc: Column) -> Column:
    slide = F.coalesce(
        F.concat((loc["slideNo"] + 1).cast("string"), F.lit("번 슬라이드")), F.lit("슬라이드?")
    )
    group = F.when(F.coalesce(loc["section"], F.lit("")).startswith("group_"), " (그룹 내부)").otherwise("")
    table = F.coalesce(F.concat((loc["tableIndex"] + 1).cast("string"), F.lit("번")), F.lit("?"))
    return (
        F.when(loc["section"].isin("shape_text", "group_shape_text"), F.concat(slide, group))
        .when(
            loc["section"].isin("table_cell", "group_table_cell"),
            F.concat(slide, group, F.lit(" 표 "), table, F.lit(" "), _one_based(loc["rowNo"]),
                     F.lit("행 "), _one_based(loc["colNo"]), F.lit("열")),
        )
        .when(loc["section"] == "notes", F.concat(slide, F.lit(" 발표자 노트")))
        .otherwise(F.concat(slide, F.lit(" ("), F.coalesce(loc["section"], F.lit("None")), F.lit(")")))
    )


def hwpx_base_label(loc: Column) -> Column:
    base = F.concat(_one_based(loc["sectionNo"]), F.lit("번 본문 "), _one_based(loc["paragraphNo"]),
                    F.lit("번째 문단"))
    return (
        F.when(loc["section"] == "body", base)
        .when(
            loc["section"] == "table_cell",
            F.concat(base, F.lit(" 표 "), _one_based(loc["tableIndex"]), F.lit("번 "),
                     _one_based(loc["rowNo"]), F.lit("행 "), _one_based(loc["colNo"]), F.lit("열")),
        )
        .otherwise(F.concat(base, F.lit(" ("), F.coalesce(loc["section"], F.lit("None")), F.lit(")")))
    )


def pdf_base_label(loc: Column) -> Column:
    base = F.concat(_one_based(loc["pageNo"]), F.lit("쪽 "), _one_based(loc["lineNo"]), F.lit("번째 줄"))
    return F.when(loc["section"] == "text_line", base).otherwise(
        F.concat(base, F.lit(" ("), F.coalesce(loc["section"], F.lit("None")), F.lit(")"))
    )


BASE_LABELS = {
    "docx": docx_base_label, "pptx": pptx_base_label, "hwpx": hwpx_base_label, "pdf": pdf_base_label,
}


def unit_label(file_type: str, loc: Column, text: Column, preceding: Column | None = None) -> Column:
    """User-facing label of a unit; section units in tables also name the text before the table."""
    label = label_with_context(BASE_LABELS[file_type](loc), text)
    if preceding is None:
        return label
    before = F.coalesce(preceding, F.lit(""))
    return F.when(
        (loc["section"] == "table_cell") & ~is_blank(before),
        F.concat(label, F.lit(" (앞 문단: "), first_chars(strip(before), 20), F.lit(")")),
    ).otherwise(label)


def location_key(loc: Column, label: Column, context: Column, order: Column) -> Column:
    """Grouping key: location fields, else label, else context, else the row's own order."""
    js = F.to_json(loc)
    return F.coalesce(
        F.when(js != "{}", js),
        F.concat(F.lit("label:"), label),
        F.concat(F.lit("context:"), context),
        F.concat(F.lit("order:"), order.cast("string")),
    )


def guide_key(file_type: str, loc: Column) -> Column:
    """Typed key of a guide location; null when a required field is missing or the section unknown."""
    s = F.coalesce(loc["section"], F.lit("body" if file_type == "docx" else ""))

    def key(section: str, *fields: str) -> Column:
        cols = [loc[f] for f in fields]
        whole = F.concat_ws(", ", F.lit(section), *[c.cast("string") for c in cols])
        given = F.lit(True)
        for c in cols:
            given = given & c.isNotNull()
        return F.when((s == section) & given, whole)

    if file_type == "docx":
        keys = [key("body", "paragraphNo"),
                key("table_cell", "tableNo", "rowNo", "colNo", "paragraphNo")]
    elif file_type == "pptx":
        keys = [key("shape_text", "slideNo", "shapeNo", "paragraphNo"),
                key("table_cell", "slideNo", "shapeNo", "rowNo", "colNo", "paragraphNo"),
                key("notes", "slideNo", "paragraphNo"),
                key("group_shape_text", "slideNo", "groupShapeNo", "shapeNo", "paragraphNo"),
                key("group_table_cell", "slideNo", "groupShapeNo", "shapeNo", "rowNo", "colNo",
                    "paragraphNo")]
    elif file_type == "hwpx":
        keys = [key("body", "sectionNo", "paragraphNo"),
                key("table_cell", "sectionNo", "paragraphNo", "tableIndex", "rowNo", "colNo",
                    "cellParagraphNo")]
    elif file_type == "pdf":
        keys = [key("text_line", "pageNo", "lineNo")]
    else:
        raise ValueError(f"no guide locations for file type {file_type!r}")
    return F.coalesce(*keys)


def guide_gap(file_type: str, loc: Column, label: Column) -> Column:
    """struct<code,message> telling why a location has no ``guide_key``; the order of the checks
    differs by file type."""
    s = F.coalesce(loc["section"], F.lit("body" if file_type == "docx" else ""))
    known = s.isin(*GUIDE_SECTIONS[file_type])

    def gap(code: str, *tail: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), F.concat(label, F.lit(": "), *tail).alias("message"))

    no_paragraph = gap("missing_paragraph_no", F.lit("paragraphNo가 없어 안내를 생성하지 못했습니다."))
    unknown = gap("unknown_section", F.lit("알 수 없는 section='"), s, F.lit("'이므로 안내를 생성하지 않습니다."))
    if file_type == "docx":
        return (
            F.when(loc["paragraphNo"].isNull(), no_paragraph)
            .when(~known, gap("unsupported_docx_section", F.lit("section="), s,
                              F.lit(" 위치는 현재 docx guide 범위 외이므로 안내를 생성하지 않습니다.")))
            .otherwise(gap("missing_table_cell_location",
                           F.lit("표 위치 메타데이터(tableNo/rowNo/colNo/paragraphNo)가 부족해 안내를 생성하지 못했습니다.")))
        )
    if file_type == "pptx":
        return (
            F.when(~known, unknown)
            .when(loc["slideNo"].isNull(),
                  gap("missing_slide_no", F.lit("slideNo가 없어 안내를 생성하지 못했습니다.")))
            .when(loc["paragraphNo"].isNull(), no_paragraph)
            .otherwise(gap("missing_shape_location",
                           F.lit("위치 필드(shapeNo/rowNo/colNo 등)가 누락되어 안내를 생성하지 못했습니다.")))
        )
    if file_type == "hwpx":
        parts = F.filter(
            F.array(*[F.when(loc[f].isNull(), F.lit(f"'{f}'"))
                      for f in ("tableIndex", "rowNo", "colNo", "cellParagraphNo")]),
            lambda x: x.isNotNull(),
        )
        return (
            F.when(~known, unknown)
            .when(loc["sectionNo"].isNull(),
                  gap("missing_section_no", F.lit("sectionNo가 없어 안내를 생성하지 못했습니다.")))
            .when(loc["paragraphNo"].isNull(), no_paragraph)
            .otherwise(gap("missing_table_cell_location",
                           F.lit("표 셀 위치 필드가 누락되어 안내를 생성하지 못했습니다. missing=["),
                           F.array_join(parts, ", "), F.lit("]")))
        )
    return (
        F.when(~known, unknown)
        .when(loc["pageNo"].isNull(),
              gap("missing_page_no", F.lit("pageNo가 없어 안내를 생성하지 못했습니다.")))
        .otherwise(gap("missing_paragraph_no", F.lit("lineNo가 누락되어 안내를 생성하지 못했습니다.")))
    )
