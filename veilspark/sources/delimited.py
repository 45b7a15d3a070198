"""Delimited files whose encoding and delimiter are not known beforehand, and labelled CSV files."""

from __future__ import annotations

import codecs
import csv
import io
import itertools
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.grades import GRADES
from veilspark.functions.text import strip
from veilspark.functions.rules import IDENTIFIER_RULES
from veilspark.operators.deid_plan import auto_targets
from veilspark.operators.detection import pattern_detections
from veilspark.operators.redaction import apply_to_text
from veilspark.sources.tables import plain_path

# Delimiters in order of preference.
DELIMITERS = (",", "\t", ";", "|")
BOM = "﻿"


# Encodings in order of preference, what is used (with replacements) where none fits, and how many characters
# of a file the delimiter is found in.
ENCODINGS = ("utf-8-sig", "cp949")
LAST_RESORT = "utf-8"
SNIFFED = 4096


class _Feed:
    """Lines for ``csv.reader``; knows when it has run out.  ``inside``: the first line goes on in a quoted cell."""

    def __init__(self, lines: Iterable[str], inside: bool = False):
        self.lines, self.opening, self.ended = iter(lines), '"' if inside else "", False

    def __iter__(self) -> _Feed:
        return self

    def __next__(self) -> str:
        for line in self.lines:
            opening, self.opening = self.opening, ""
            return opening + line
        self.ended = True
        raise StopIteration


def _records(lines: Iterable[str], delimiter: str, inside: bool = False) -> Iterator[tuple[list[str], bool]]:
    """(cells, whether the row is still open) of every row: a row given out when the lines have ended misses its end."""
    csv.field_size_limit(1 << 31)  # cells may be as long as a row can be
    feed = _Feed(lines, inside)
    for cells in csv.reader(feed, delimiter=delimiter):
        yield cells, feed.ended


def _split(line: str) -> Iterable[str]:
    """A line, cut at carriage returns, which end rows too."""
    return io.StringIO(line, newline="") if "\r" in line else (line,)


def _step(line: str, delimiter: str, inside: bool) -> tuple[int, bool]:
    """(rows that end with this piece of a line, whether a quoted cell is open after it)."""
    if '"' not in line:
        return (0, True) if inside else (1, False)
    (_, is_open), *_ = _records((line,), delimiter, inside)
    return int(not is_open), is_open


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, block, size, line): raw lines in file order within a block, the part of a file that one split reads.

    Line feeds are no part of any character of the encodings, nor are quotes and delimiters; so files may be cut at them,
    and structure can be read from bytes, before the encoding is known."""
    files = spark.read.option("lineSep", "\n").text(list(paths) if not isinstance(paths, str) else paths)
    return files.select(
        plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], Iterator[bytes]]]:
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for key, group in itertools.groupby(rows, key=lambda r: r[:3]):
        yield key, (r[3] for r in group)


def _row_sizes(head: str, delimiter: str) -> list[int] | None:
    """Cells of every row of a file's start (of the last one only if no other is complete); None where a cell holds a quote
    that neither opens nor closes it nor is doubled."""
    d, quoted = re.escape(delimiter), re.compile(r'"(?:[^"]|"")*+"')
    cell = rf'(?:{quoted.pattern}|[^"\r\n{d}]*+)'
    row = re.compile(rf"{cell}(?:{d}{cell})*+(?:\r\n|\r|\n)")
    sizes, at = [], 0
    while found := row.match(head, at):
        sizes.append(quoted.sub("", found[0]).count(delimiter) + 1)
        at = found.end()
    rest = re.compile(rf'((?:{cell}{d})*+)(?:{cell}|"(?:[^"]|"")*+)').fullmatch(head, at)
    if rest is None:
        return None
    return sizes or [quoted.sub("", rest[1]).count(delimiter) + 1]


def _delimiter(head: str) -> str:
    """The sniffer's choice.  Where that one leaves quotes inside of unquoted cells, the first delimiter is taken that reads
    the file's start as well-formed rows of equal size, if there is one."""
    try:
        sniffed = csv.Sniffer().sniff(head, delimiters="".join(DELIMITERS)).delimiter
    except csv.Error:
        sniffed = ","
    if _row_sizes(head, sniffed) is None:
        for d in DELIMITERS:
            sizes = _row_sizes(head, d)
            if sizes and sizes[0] > 1 and len(set(sizes)) == 1:
                return d
    return sniffed


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: which readings fit all of it, its bytes, and the delimiter the file's start shows in each reading."""
    for (path, block, size), lines in _by_block(batches):
        fits, n, head = [True] * len(_READINGS), 0, []
        for line in lines:
            first = block == 0 and n == 0
            if block == 0 and n < 4 * SNIFFED:
                head.append(line)
            n += len(line) + 1
            if first or not line.isascii():
                for i, (encoding, mark) in enumerate(_READINGS[:-2]):
                    try:
                        fits[i] = fits[i] and ((mark if first else b"") + line).decode(encoding) is not None
                    except UnicodeDecodeError:
                        fits[i] = False
        start = b"\n".join(head)
        shown = [_delimiter((mark + start).decode(e, "replace")[:SNIFFED]) for e, mark in _READINGS] if block == 0 else []
        yield pa.RecordBatch.from_pylist(
            [{"path": path, "block": block, "size": size, "n": n, "fits": fits, "delimiters": shown}], schema=_SURVEY)


#: The reader leaves out a byte-order mark.  It belongs to the text in every encoding but the first.
_READINGS = [(ENCODINGS[0], b""), (ENCODINGS[1], b""), (ENCODINGS[1], codecs.BOM_UTF8), (LAST_RESORT, b""), (LAST_RESORT, codecs.BOM_UTF8)]
_SURVEY = pa.schema([("path", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("n", pa.int64()),
                     ("fits", pa.list_(pa.bool_())), ("delimiters", pa.list_(pa.string()))])


@dataclass
class _File:
    """What is known of a file: how to read it, whether a line feed ends it, and for each block where its rows start."""

    encoding: str
    mark: bytes
    delimiter: str
    ends: bool
    blocks: dict[int, tuple[bool, int, int, bool]] = field(default_factory=dict)  # inside, rows before, rows ending, open after

    def text(self, lines: Iterator[bytes], block: int) -> Iterator[str]:
        """Decoded pieces of lines with their line ends."""
        mark = self.mark if block == 0 else b""
        for line in lines:
            yield from _split((mark + line).decode(self.encoding.removesuffix("-sig"), "replace") + "\n")
            mark = b""


def _profiled(lines: DataFrame) -> dict[str, _File]:
    found: dict[str, list] = {}
    for r in lines.mapInArrow(_surveyed, "path string, block bigint, size bigint, n bigint, fits array<boolean>, delimiters array<string>").toLocalIterator():
        own = found.setdefault(r.path, [[True] * len(_READINGS), [","] * len(_READINGS), -r.size])
        own[0] = [a and b for a, b in zip(own[0], r.fits)]
        own[1] = r.delimiters or own[1]
        own[2] += r.n
    files = {}
    for path, (fits, delimiters, over) in found.items():
        marked = over < 0  # bytes that the lines and their ends don't make up
        i = next(i for i, (e, mark) in enumerate(_READINGS) if fits[i] and (bool(mark) == marked or e == ENCODINGS[0]))
        files[path] = _File(*_READINGS[i], delimiters[i], over in (0, -len(codecs.BOM_UTF8)))
    return files


def profile_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, encoding, delimiter) per file."""
    return spark.createDataFrame([(p, f.encoding, f.delimiter) for p, f in _profiled(_lines(spark, paths)).items()],
                                 "path string, encoding string, delimiter string")


def _place_blocks(lines: DataFrame, files: dict[str, _File]) -> None:
    """Fill in where the rows of every block start.

    A block begins at a row or inside a quoted cell.  What it does to either is found without knowing which it is; going
    through a file's blocks in order, each one's end then tells the beginning of the next."""
    known = lines.sparkSession.sparkContext.broadcast({p: (f.delimiter, f.mark) for p, f in files.items()})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, block, _), own in _by_block(batches):
            (delimiter, mark), rows, inside = known.value[path], [0, 0], [False, True]
            for i, line in enumerate(own):
                if block == 0 and i == 0:
                    line = mark + line
                for piece in _split(line.decode("latin-1") + "\n"):
                    for start in (0, 1):
                        n, inside[start] = _step(piece, delimiter, inside[start])
                        rows[start] += n
            yield pa.RecordBatch.from_pydict({"path": [path], "block": [block], "rows": [rows], "open": [inside]}, schema=pa.schema(
                [("path", pa.string()), ("block", pa.int64()), ("rows", pa.list_(pa.int64())), ("open", pa.list_(pa.bool_()))]))

    blocks: dict[str, list] = {}
    for r in lines.mapInArrow(counted, "path string, block bigint, rows array<bigint>, open array<boolean>").toLocalIterator():
        blocks.setdefault(r.path, []).append((r.block, r.rows, r.open))
    for path, own in blocks.items():
        inside, before = False, 0
        for block, rows, is_open in sorted(own):
            files[path].blocks[block] = (inside, before, rows[inside], is_open[inside])
            inside, before = is_open[inside], before + rows[inside]
    known.destroy()


_ROWS = pa.schema([("path", pa.string()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string())), ("delimiter", pa.string())])
_ROWS_DDL = "path string, row_no int, cells array<string>, delimiter string"


def read_delimited(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Rows (path, row_no from 1, cells array, delimiter) of all files; the first row is data and header.

    Every row keeps its own number of cells, empty ones included; an empty line is a row without cells.  A file of any size
    is read by as many tasks as it has splits.  A first pass finds encodings and delimiters, a second one how many rows end
    in each block for both states in which it can begin; putting these together in order gives every block its first row
    and that row's number.  Then each block's rows are parsed where they are read.  Only rows that reach over a border
    of blocks are put together by a shuffle of their lines.  The driver holds a few numbers per split, as it does for
    the listing of the files.  A row has to fit into a task; a quoted cell that is never closed is one row up to the file's
    end."""
    lines = _lines(spark, paths)
    files = _profiled(lines)
    _place_blocks(lines, files)
    known = spark.sparkContext.broadcast(files)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, block, _), own in _by_block(batches):
            file = known.value[path]
            inside, before, ending, _ = file.blocks[block]
            if ending <= inside:  # the block ends no row but one that began earlier
                continue
            rows = (cells for cells, is_open in _records(file.text(own, block), file.delimiter, inside) if not is_open)
            if inside:
                next(rows)
            first = before + inside + 1
            while part := list(itertools.islice(rows, 2000)):
                n = len(part)
                yield pa.RecordBatch.from_pydict(
                    {"path": [path] * n, "row_no": range(first, first + n), "cells": part, "delimiter": [file.delimiter] * n}, schema=_ROWS)
                first += n

    inner = lines.mapInArrow(parsed, _ROWS_DDL)
    if not any(inside or is_open for f in files.values() for inside, _, _, is_open in f.blocks.values()):
        return inner

    def over_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of rows that began in an earlier block or that the block leaves open."""
        schema = pa.schema([("path", pa.string()), ("row_no", pa.int32()), ("block", pa.int64()), ("no", pa.int64()), ("piece", pa.string())])
        for (path, block, _), own in _by_block(batches):
            file = known.value[path]
            inside, before, ending, is_open = file.blocks[block]
            if not inside and not is_open:
                continue
            now, row, held = inside, before + 1, []
            for no, piece in enumerate(file.text(own, block)):
                held.append((no, piece))
                ended, now = _step(piece, file.delimiter, now)
                if ended or len(held) >= 2000:
                    if inside and row == before + 1 or row == before + ending + 1:
                        yield pa.RecordBatch.from_pylist([{"path": path, "row_no": row, "block": block, "no": k, "piece": p} for k, p in held], schema=schema)
                    row, held = row + ended, []
            if held:
                yield pa.RecordBatch.from_pylist([{"path": path, "row_no": row, "block": block, "no": k, "piece": p} for k, p in held], schema=schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for (path, row), group in itertools.groupby(rows, key=lambda r: r[:2]):
            file = known.value[path]
            last = file.blocks[max(file.blocks)]
            pieces = [r[4] for r in group]
            if last[3] and row == last[1] + last[2] + 1 and not file.ends:  # never closed: its last line has no end
                pieces[-1] = pieces[-1].removesuffix("\n")
            cells = next(_records(pieces, file.delimiter))[0]
            yield pa.RecordBatch.from_pydict({"path": [path], "row_no": [row], "cells": [cells], "delimiter": [file.delimiter]}, schema=_ROWS)

    pieces = lines.mapInArrow(over_borders, "path string, row_no int, block bigint, no bigint, piece string")
    across = pieces.repartition("path", "row_no").sortWithinPartitions("path", "row_no", "block", "no").mapInArrow(joined, _ROWS_DDL)
    return inner.union(across)


def with_headers(rows: DataFrame) -> DataFrame:
    """Add each file's first row as ``headers``: one small row per file meets its rows."""
    heads = rows.where("row_no = 1").select("path", F.col("cells").alias("headers"))
    return rows.join(heads, "path", "left")


def redact_rows(rows: DataFrame, deletion_mode: str = "mark") -> DataFrame:
    """Rows with redacted cells, all rows and columns kept.  Row-local."""
    def redacted(c: Column) -> Column:
        found = auto_targets(pattern_detections(c, IDENTIFIER_RULES, "cell"))
        return apply_to_text(c, found, deletion_mode)["text"]

    return rows.withColumn("cells", F.transform("cells", redacted))


def csv_line(cells: Column, delimiter: Column | str) -> Column:
    """One output line with minimal quoting."""
    delimiter = F.lit(delimiter) if isinstance(delimiter, str) else delimiter
    quoted = F.transform(cells, lambda c: F.when(
        c.rlike('["\\r\\n]') | F.contains(c, delimiter),
        F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    return F.when((F.size(cells) == 1) & (F.get(cells, F.lit(0)) == ""), '""').otherwise(
        F.call_function("array_join", quoted, delimiter))


def write_redacted(rows: DataFrame, path: str, delimiter: str | None = None) -> None:
    """Redacted rows (path, row_no, cells) as CSV text, byte-order mark first, in row order.

    Each file has a folder below that of its source folder, and keeps its own ``delimiter`` column unless one is given
    (comma where there is neither)."""
    own = F.lit(delimiter or ",") if delimiter or "delimiter" not in rows.columns else F.coalesce("delimiter", F.lit(","))
    line = csv_line(F.col("cells"), own)
    marked = F.when(F.col("row_no") == 1, F.concat(F.lit(BOM), line)).otherwise(line)
    rows.repartitionByRange("path", "row_no").sortWithinPartitions("path", "row_no").select(
        F.regexp_extract("path", r"^(.*/)?[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
        marked.alias("value")
    ).write.mode("overwrite").partitionBy("folder", "file").option("lineSep", "\r\n").text(path)


def read_labelled(
    spark: SparkSession, paths: str | Sequence[str], required: Sequence[str] = ("text", "cso_grade"),
    grade: str = "cso_grade",
) -> DataFrame:
    """Labelled rows: required columns are checked at once, blank texts dropped, unknown grades fail."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(
        list(paths) if not isinstance(paths, str) else paths)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    g = strip(F.coalesce(grade, F.lit("")))
    checked = F.when(g.isin(*GRADES), g).otherwise(
        F.raise_error(F.concat(F.lit("unknown grade: "), g)).cast("string"))
    return df.withColumn("text", strip(F.coalesce("text", F.lit("")))).where(F.col("text") != "").withColumn(
        grade, checked)
