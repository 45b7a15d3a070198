"""From raw documents to packed training sequences: five stages, each a table that the next one reads.

Every stage works on all that its predecessor kept; ``run`` writes each result to a shared folder and reads it back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.decontamination import mark_hits
from veilspark.llm.language_id import identify_language, learn_dictionaries
from veilspark.llm.line_dedup import dedup_lines
from veilspark.llm.ngram_join import one_of_each
from veilspark.llm.packing import pack
from veilspark.llm.queries import learning_rows, tokenizer_file
from veilspark.llm.shared import saved


def _apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` on ``docs``, with every column that no operator reads under a name that no operator uses; all come back."""
    own = [c if c in ("doc_id", "text", "lang", "n_chars") else f"_column_{i}" for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*own)).select(*own).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letter, or too narrow a margin) go.

    Null, empty and blank texts go, having no letter; repeated rows are judged alike, rows without an id like others; an
    empty table stays empty."""
    def kept(d: DataFrame) -> DataFrame:
        return identify_language(d, learn_dictionaries(learning_rows(d, 4, 2))).where(~F.col("rejected"))

    return _apart(docs, kept)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows the text of rows that lost a line.

    No row goes: null and empty texts come back empty; rows that share an id are one document, a row without one loses
    nothing; an empty table stays empty."""
    def kept(d: DataFrame) -> DataFrame:
        done = dedup_lines(d)
        if "n_chars" not in d.columns:
            return done
        kind = d.schema["n_chars"].dataType
        return done.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))

    return _apart(docs, kept)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal shingle sets the row with the smallest doc_id stays; of repeated rows, one.

    Rows are judged each for itself, also where they share an id or have none; see ``one_of_each`` for ties, nulls and
    texts without words.  An empty table stays empty."""
    return _apart(docs, one_of_each)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Null and empty texts hold none and stay; rows are judged each for itself, whatever their ids; an empty table stays
    empty."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _apart(docs, lambda d: mark_hits(d, items).where(~F.col("contaminated")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 token ids; every row is packed, a null or empty text as its end id alone."""
    return pack(docs, tokenizer_file())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Compression sizes and token ids are not expressible in SQL; the tests compare with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
