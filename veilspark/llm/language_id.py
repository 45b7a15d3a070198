"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.shared import add_columns

_BLOCK = 1 << 16
_LETTER = regex.compile(r"\p{L}")
#: ASCII bytes that are no letters become blanks; marks, digits and separators say nothing about a language.
_TABLE = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def plain(text: str) -> bytes:
    """The whole text, lower-cased, ASCII letters and non-ASCII characters only, with single blanks between."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split())


def learn_dictionaries(
    labelled: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", rows: int = 600, excerpt: int = 1000,
    most_rows: int = 120_000,
) -> dict[str, bytes]:
    """A raw-content dictionary per language: excerpts of labelled rows in plain form, one after another.

    Every label is learned.  The sample is bounded by parameters and documented: about ``rows`` rows of each label, fewer of
    each where the labels are so many that this would be more than ``most_rows``, but at least one, chosen by hash of id
    and text; and ``excerpt`` characters of each, from a place in the whole text that a hash chooses.  Only labels are counted
    over all rows; the sample is then taken by a filter, without a shuffle of texts.  Rows with a null label or text teach
    nothing."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    place, size = F.xxhash64(F.col(id).cast("string"), F.length(text)), F.length(text)
    chance = F.pmod(place, F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = {r[0]: (r[1], r[2]) for r in known.groupBy(lang).agg(F.count("*"), F.min(chance)).collect()}
    if not counts:
        return {}
    rows = max(1, min(rows, most_rows // len(counts)))
    shares = labelled.sparkSession.createDataFrame(
        [(k, max(rows / n, least)) for k, (n, least) in counts.items()],
        T.StructType([T.StructField(lang, labelled.schema[lang].dataType), T.StructField("_share", T.DoubleType())]))
    start = (F.pmod(F.xxhash64(place), F.greatest(size - excerpt + 1, F.lit(1))) + 1).cast("int")
    first = Window.partitionBy(lang).orderBy("c", "t")
    sample = (
        known.join(F.broadcast(shares), lang).where(chance <= F.col("_share"))
        .select(F.col(lang), F.substring(F.col(text), start, F.lit(excerpt)).alias("t"), chance.alias("c"))
        .withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= 2 * rows).drop("_n").orderBy("c", "t").collect()
    )
    out: dict[str, list[bytes]] = {k: [] for k in counts}
    for k, t, _ in sample:
        out[k].append(plain(t))
    return {k: b" ".join(v) for k, v in sorted(out.items()) if v}


def identify_language(
    documents: DataFrame, dictionaries: dict[str, bytes], text: str = "text", level: int = 3, margin: float = 0.002, unknown: str = "und",
) -> DataFrame:
    """``documents`` with ``lang_pred``, ``score`` and ``rejected``.

    Each whole text, in plain form, is compressed with every language's zstandard dictionary; the smallest result names the
    language, at a tie the first name.  A long text is compressed in blocks of 64 KB, whose sizes are summed: what a dictionary
    saves is bounded, and over one long stream the margin would shrink with the length.  ``score`` (0 to 1) is the share of bytes saved against the second best language.
    ``rejected`` is set where this margin is at most ``margin``, and for texts without a letter.  Null texts, and texts
    without a letter, are ``unknown`` with score 0; with one learned language every other text gets it with score 1, with
    none ``unknown``.  Rows are neither shuffled nor dropped; input columns named like a result are replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(dictionaries)  # bounded by the sample's parameters
    documents = documents.drop("lang_pred", "score", "rejected")
    at = documents.columns.index(text)

    def learned():
        import zstandard

        out = []
        for name, data in shared.value.items():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            out.append((name, zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)))
        return out

    def fn(b: pa.RecordBatch, models) -> dict:
        names, scores, rejected = [], [], []
        for t in b.column(at).to_pylist():
            if not models or not t or not _LETTER.search(t):
                name, score = unknown, 0.0
            else:
                data = plain(t)
                cut = [data[i : i + _BLOCK] for i in range(0, len(data), _BLOCK)]
                sizes = sorted((sum(len(c.compress(x)) for x in cut), k) for k, c in models)
                name = sizes[0][1]
                score = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
            names.append(name)
            scores.append(score)
            rejected.append(name == unknown or score <= margin)
        return {"lang_pred": names, "score": scores, "rejected": rejected}

    return add_columns(documents, "lang_pred string, score double, rejected boolean", fn, learned)
