"""Markdown corpus and keyword configuration."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.keywords import KeywordPack, pack_from_config
from veilspark.functions.text import unify_line_ends
from veilspark.sources.tables import plain_path

try:
    import yaml
except ImportError:  # JSON configurations still work
    yaml = None


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, content) of the ``*.md`` files below a directory; broken UTF-8 is replaced."""
    return spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(
        plain_path(F.col("_metadata.file_name")).alias("source_file"),
        unify_line_ends(F.make_valid_utf8("value")).alias("content"))


def read_markdown_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, line_no, text) of the lines of the ``*.md`` files below a directory, for files larger than a row can be.

    Files are read by as many tasks as they have splits.  ``line_no`` is the split's start plus the line's number in it: it
    rises along the file and has gaps, as no line is shorter than a byte.  Broken UTF-8 is replaced; a carriage return,
    with or without a line feed, ends a line; a byte-order mark is left out."""
    lines = spark.read.option("pathGlobFilter", "*.md").option("lineSep", "\n").text(path).select(
        plain_path(F.col("_metadata.file_name")).alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8("value").alias("line"))
    kind = pa.schema([("source_file", pa.string()), ("line_no", pa.int64()), ("text", pa.string())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for b in batches:
            files, places, texts = [], [], []
            for file, block, line in zip(*(c.to_pylist() for c in b.columns)):
                if (file, block) != last:
                    last, at = (file, block), block
                for piece in line.removesuffix("\r").split("\r"):
                    files.append(file)
                    places.append(at)
                    texts.append(piece)
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], schema=kind)

    return lines.mapInArrow(placed, "source_file string, line_no bigint, text string")


def read_keywords(spark: SparkSession, path: str) -> KeywordPack:
    """Keyword pack from a YAML or JSON file.  The file is configuration: one row on the driver."""
    body = spark.read.text(path, wholetext=True).first()["value"]
    if yaml is not None:
        return pack_from_config(yaml.safe_load(body) or {})
    try:
        return pack_from_config(json.loads(body))
    except json.JSONDecodeError as e:
        raise ImportError("reading a YAML keyword file needs PyYAML; give JSON instead") from e


def keyword_rows(spark: SparkSession, pack: KeywordPack) -> DataFrame:
    """The pack as a table."""
    return spark.createDataFrame(pack.rows(), "role string, track string, grp string, kw string, norm_kw string")
