"""Features, training and scoring of grade classifiers with Spark ML.

Tokens are SQL expressions, so they work in a projection, in ``SQLTransformer`` stages of a saved
pipeline, and in plain SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import (
    IDF, ElementwiseProduct, HashingTF, Normalizer, SQLTransformer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasNumFeatures, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.grades import GRADES
from veilspark.functions.keywords import KeywordPack, normalized, role_matches
from veilspark.functions.running import smallest_by_hash
from veilspark.functions.text import let
from veilspark.operators.linear import SparseRows, fit_margins, fit_sigmoids, fit_softmax, margin_model

PARTS_PER_CORE = 4  # of the rows that a model is fitted on
KEYWORD_FEATURES = ("strong_procedural", "s_business_sensitive", "ambiguous_action", "weak")


# --- tokens ------------------------------------------------------------------------------------------

def spaced_words_sql(text: str) -> str:
    """Lower-case words between white space: the characters of ``(?U)\\s``, which by that name are looked up one by one."""
    return rf"filter(split(lower({text}), '[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+'), w -> w != '')"


def word_bounded_ngrams_sql(text: str, lo: int = 2, hi: int = 4) -> str:
    """Character n-grams inside words padded with one space.  A word shorter than n yields itself
    once and nothing longer."""
    words = rf"filter(split(trim(regexp_replace(lower({text}), '(?U)\\s+', ' ')), ' '), w -> w != '')"
    grams = (
        f"transform(sequence({lo}, {hi}), n -> if(n > {lo} and length(p) < n, cast(array() as array<string>), "
        "transform(sequence(1, greatest(length(p) - n + 1, 1)), i -> substring(p, i, n))))"
    )
    return f"flatten(flatten(transform(transform({words}, w -> concat(' ', w, ' ')), p -> {grams})))"


def _joined_runs(items: str, sep: str, lo: int, hi: int) -> str:
    """Runs of lo..hi neighbouring items joined with ``sep``.  Items are addressed by index: taking
    slices or substrings of a long text would make every run cost the whole text."""
    def run(n: int) -> str:
        if n == 1:
            return "xs"
        joined = f", '{sep}', ".join(f"get(xs, i + {j})" for j in range(n))
        return f"if(size(xs) < {n}, cast(array() as array<string>), transform(sequence(0, greatest(size(xs) - {n}, 0)), i -> concat({joined})))"

    return f"flatten(transform(array({items}), xs -> concat({', '.join(run(n) for n in range(lo, hi + 1))})))"


def char_ngrams_sql(text: str, lo: int = 2, hi: int = 5) -> str:
    """Character n-grams of the whole text, white-space runs counted as one space."""
    chars = rf"filter(split(regexp_replace(lower({text}), '(?U)\\s\\s+', ' '), ''), c -> c != '')"
    return _joined_runs(chars, "", lo, hi)


def word_ngrams_sql(text: str, lo: int = 1, hi: int = 2) -> str:
    """Words of at least two characters, single and in sequences.  A greedy run of word characters needs no borders, and
    Latin letters are told first: the Unicode class is a slow one."""
    return _joined_runs(rf"regexp_extract_all(lower({text}), '(?U)[a-z\\w][a-z\\w]+', 0)", " ", lo, hi)


TOKENS = {"char_wb": word_bounded_ngrams_sql, "char": char_ngrams_sql, "word": word_ngrams_sql}


def token_counts(df: DataFrame, key: str, text: str = "text", kind: str = "char_wb") -> DataFrame:
    """(key, term, tf)."""
    return df.select(key, F.explode(F.expr(TOKENS[kind](text))).alias("term")).groupBy(key, "term").agg(
        F.count("*").alias("tf"))


def counted_terms_sql(tokens: str) -> str:
    """An array of (term, tf) from an array of tokens: sorted (by ``sort_array``, which calls no function for each pair), and
    cut where the term changes.  Linear after the sort, and inside the row."""
    firsts = "filter(sequence(0, size(s) - 1), i -> i = 0 or get(s, i) <> get(s, i - 1))"
    runs = "transform(f, (a, j) -> struct(get(s, a) as term, cast(coalesce(get(f, j + 1), size(s)) - a as bigint) as tf))"
    return (f"transform(array(sort_array({tokens})), s -> if(size(s) = 0, cast(array() as array<struct<term: string, tf: bigint>>), "
            f"transform(array({firsts}), f -> {runs})[0]))[0]")


def tfidf(df: DataFrame, key: str, text: str = "text", kind: str = "char_wb") -> DataFrame:
    """(key, term, tf, df, weight): tf * (ln((1 + n) / (1 + df)) + 1), each text scaled to length 1.  A row is a text; its
    key should be its own.

    Terms are counted inside the row, so pairs move twice: to their term's frequency and back to their text.  A term's
    frequency is one row, so adaptive execution can split the pairs of a frequent term."""
    tf = df.select(key, F.inline(F.expr(counted_terms_sql(TOKENS[kind](text)))))
    dfreq = tf.groupBy("term").agg(F.count("*").alias("df")).withColumn("_j", F.lit(1))
    n = df.agg(F.count("*").alias("n")).withColumn("_j", F.lit(1))
    idf = dfreq.join(F.broadcast(n), "_j").select(
        "term", "df", (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"))
    raw = tf.join(idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    # A window instead of a second pass joined back: the terms of one text are bounded by it.
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.select(key, "term", "tf", "df", (F.col("raw") / norm).alias("weight"))


def keyword_counts(df: DataFrame, pack: KeywordPack, text: str = "text") -> DataFrame:
    """Number of matched keywords per role used as a feature."""
    norm = normalized(F.col(text))
    return df.withColumn("_norm", norm).withColumns(
        {f"kw_{r}": F.size(role_matches(F.col("_norm"), pack, r)) for r in KEYWORD_FEATURES}).drop("_norm")


# --- splits -------------------------------------------------------------------------------------------

def split_key(key: str, seed: int = 42) -> Column:
    """Evenly spread, reproducible order of the rows."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)


def stratified_split(
    df: DataFrame, key: str, label: str = "label", share: float = 0.2, seed: int = 42, augmented: str | None = "augmented"
) -> DataFrame:
    """Mark ``part`` train/test: per label the given share of the original rows (rounded) is test;
    augmented rows are always train."""
    original = df
    extra = None
    if augmented and augmented in df.columns:
        flag = F.coalesce(F.trim(F.col(augmented).cast("string")), F.lit("0"))
        original, extra = df.where(flag == "0"), df.where(flag == "1")
    marked = smallest_by_hash(
        original.withColumn("_h", split_key(key, seed)), "_h", F.round(F.col("_total") * share).cast("bigint"),
        by=label, domain=GRADES)
    out = marked.withColumn("part", F.when(F.col("chosen"), "test").otherwise("train")).drop("chosen", "_h")
    return out if extra is None else out.unionByName(extra.withColumn("part", F.lit("train")))


def shuffled_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Mark ``part`` train/validation: max(1, int(n * share)) rows are validation."""
    marked = smallest_by_hash(
        df.withColumn("_h", split_key(key, seed)), "_h",
        F.greatest(F.lit(1), F.floor(F.col("_total") * share)).cast("bigint"))
    return marked.withColumn("part", F.when(F.col("chosen"), "validation").otherwise("train")).drop("chosen", "_h")


def with_balanced_weight(df: DataFrame, label: str = "label", classes: Sequence[str] = GRADES) -> DataFrame:
    """Add ``weight`` = n / (k * n_label).  At most one row per class is broadcast."""
    per = df.where(F.col(label).isin(*classes)).groupBy(label).agg(F.count("*").alias("_n"))
    total = per.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k")).withColumn("_j", F.lit(1))
    weights = per.withColumn("_j", F.lit(1)).join(F.broadcast(total), "_j").select(
        label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(weights), label)


# --- hashed n-grams of words ---------------------------------------------------------------------------

WORDS_AT_ONCE = 2048  # their n-grams stay in the processor's cache
_VECTOR = pa.struct([pa.field("type", pa.int8(), False), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint32(by) | x >> np.uint32(32 - by)


def hashed_indexes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """The index that ``HashingTF`` gives each term data[begin:end] (UTF-8 bytes): 32-bit MurmurHash3, seed 42, signed, modulo
    ``width``."""
    padded = np.append(data, np.zeros(4, np.uint8)).astype(np.uint32)
    four = padded[:-3] | padded[1:-2] << np.uint32(8) | padded[2:-1] << np.uint32(16) | padded[3:] << np.uint32(24)
    size = (end - begin).astype(np.uint32)
    h = np.full(len(begin), 42, np.uint32)

    def mixed(k: np.ndarray) -> np.ndarray:
        return _turned(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)

    for block in range(int(size.max(initial=0)) // 4):
        has = np.flatnonzero(size >= 4 * block + 4)
        h[has] = _turned(h[has] ^ mixed(four[begin[has] + 4 * block]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    left = size & np.uint32(3)
    has = np.flatnonzero(left)
    rest = four[end[has] - left[has]] & (np.uint32(1) << np.uint32(8) * left[has]) - np.uint32(1)
    h[has] ^= mixed(rest)
    h ^= size
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return (h.view(np.int32).astype(np.int64) % width).astype(np.int32)


def _word_grams(words: Sequence[str], width: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of the n-grams of every word between spaces, word by word; their number in each word)."""
    if not len(words):
        return np.empty(0, np.int32), np.zeros(0, np.int64)
    data = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-8"), np.uint8)
    byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where each character begins
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(length) - length
    each = [np.maximum(length - n + 1, 1 if n == lo else 0) for n in range(lo, hi + 1)]
    sizes = sum(each)
    out, filled = np.empty(sizes.sum(), np.int32), np.cumsum(sizes) - sizes
    for n, size in zip(range(lo, hi + 1), each):
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(first, size) + step
        stop = np.minimum(at + n, np.repeat(first + length, size))
        out[np.repeat(filled, size) + step] = hashed_indexes(data, byte[at], byte[stop], width)
        filled += size
    return out, sizes


def hashed_counts(lists: pa.Array, width: int, lo: int = 2, hi: int = 4) -> pa.Array:
    """Lists of words to sparse vectors: counts of their n-grams by index.  The indexes of a word are found once a batch."""
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    found = [_word_grams(words[i : i + WORDS_AT_ONCE], width, lo, hi) for i in range(0, max(1, len(words)), WORDS_AT_ONCE)]
    flat, sizes = (np.concatenate(x) for x in zip(*found))
    begins = np.cumsum(sizes) - sizes
    codes = coded.indices.to_numpy()
    at, counts, offsets, last = [np.empty(0, np.int32)], [np.empty(0)], [0], 0
    for end in np.cumsum([x or 0 for x in lists.value_lengths().to_pylist()]):
        own = codes[last:end]
        size = sizes[own]
        total = int(size.sum())
        s = np.sort(flat[np.repeat(begins[own] - np.cumsum(size) + size, size) + np.arange(total)])
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if total else np.empty(0, np.int64)
        at.append(s[first])
        counts.append(np.diff(np.append(first, total)).astype(float))
        offsets.append(offsets[-1] + len(first))
        last = end
    ends = pa.array(offsets, pa.int32())
    return pa.StructArray.from_arrays([
        pa.array(np.zeros(len(lists), np.int8)), pa.array(np.full(len(lists), width, np.int32)),
        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(at))),
        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(counts)))], fields=list(_VECTOR))


class HashedWordNgrams(Transformer, HasInputCol, HasOutputCol, HasNumFeatures, DefaultParamsReadable, DefaultParamsWritable):
    """``HashingTF`` of the terms of ``word_bounded_ngrams_sql``, from the words (``spaced_words_sql``): the same vectors.

    A text's n-grams are never made as strings: the indexes of every word are found once a batch and gathered."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, numFeatures: int = 1 << 18):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        width = self.getNumFeatures()

        def counts(lists: pa.Array) -> pa.Array:
            return hashed_counts(lists, width)

        counts.__annotations__ = {"lists": pa.Array, "return": pa.Array}
        vector = F.arrow_udf(counts, VectorUDT())(F.col(self.getInputCol()))
        return dataset.withColumn(self.getOutputCol(), vector).withMetadata(self.getOutputCol(), {"ml_attr": {"num_attrs": width}})


# --- pipelines -----------------------------------------------------------------------------------------

def fit_features(
    train: DataFrame, kinds: Sequence[str] = ("char_wb",), pack: KeywordPack | None = None,
    text: str = "text", width: int = 1 << 18,
) -> PipelineModel:
    """Fitted feature stages: per token kind tf-idf with smoothed idf and unit length, optionally the
    keyword counts, assembled into ``features``.

    Every term counts: it is indexed by its hash, so no vocabulary is cut off or brought to the driver.  Terms that meet in
    one of the ``width`` indexes share a weight."""
    stages, parts = [], []
    alone = len(kinds) == 1 and pack is None  # an assembler would name every index in the column's metadata
    for kind in kinds:
        tokens, hashing = (spaced_words_sql, HashedWordNgrams) if kind == "char_wb" else (TOKENS[kind], HashingTF)
        tok = SQLTransformer(statement=f"SELECT *, {tokens(text)} AS tok_{kind} FROM __THIS__")
        counts = hashing(inputCol=f"tok_{kind}", outputCol=f"tf_{kind}", numFeatures=width)
        fitted = Pipeline(stages=[tok, counts, IDF(inputCol=f"tf_{kind}", outputCol=f"idf_{kind}")]).fit(train)
        weights = Vectors.dense(fitted.stages[2].idf.toArray() + 1.0)
        stages += [
            fitted.stages[0], fitted.stages[1],
            ElementwiseProduct(inputCol=f"tf_{kind}", outputCol=f"w_{kind}", scalingVec=weights),
            Normalizer(inputCol=f"w_{kind}", outputCol="features" if alone else f"x_{kind}", p=2.0),
        ]
        parts.append(f"x_{kind}")
    if pack is not None:
        parts += [f"kw_{r}" for r in KEYWORD_FEATURES]
    if not alone:
        stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return PipelineModel(stages)


def _indexed(df: DataFrame, label: str = "label") -> DataFrame:
    y = F.lit(None).cast("double")
    for i, g in enumerate(GRADES):
        y = F.when(F.col(label) == g, F.lit(float(i))).otherwise(y)
    return df.withColumn("y", y)


def _graded(df: DataFrame, probs: Column) -> DataFrame:
    best = F.greatest("p_c", "p_s", "p_o")
    return df.withColumn("_p", probs).withColumns({
        f"p_{g.lower()}": F.get("_p", F.lit(i)) for i, g in enumerate(GRADES)
    }).drop("_p").withColumns({
        "pred": F.when(F.col("p_c") == best, "C").when(F.col("p_s") == best, "S").otherwise("O"),
        "confidence": best,
    })


class GradeModel:
    """Fitted features plus a classifier; ``score`` adds p_c, p_s, p_o, pred and confidence."""

    def __init__(self, features: PipelineModel, pack: KeywordPack | None):
        self.features, self.pack = features, pack

    def _prepare(self, df: DataFrame, text: str = "text") -> DataFrame:
        out = keyword_counts(df, self.pack, text) if self.pack is not None else df
        return self.features.transform(out)

    def _rows(self, train: DataFrame, fold: Column) -> SparseRows:
        """The labelled rows as fitting reads them, tokens and vectors made once; rows of other labels are left out."""
        known = _indexed(train.where(F.col("label").isin(*GRADES)).withColumn("fold", fold))
        prepared = self._prepare(known)
        return SparseRows(prepared.select("y", "fold", "features"), _width(prepared))

    def _keep(self, context: SparkContext, coefficients: np.ndarray, intercepts: np.ndarray) -> None:
        self.coefficients, self.intercepts = coefficients, intercepts
        self.model = margin_model(context, coefficients, intercepts)

    def margins(self, df: DataFrame) -> DataFrame:
        """``df`` with the array ``margins``: one for every row of the coefficients."""
        return self.model.transform(self._prepare(df)).withColumn("margins", vector_to_array("rawPrediction")).select(*df.columns, "margins")

    def score(self, df: DataFrame) -> DataFrame:
        scored = _graded(self.margins(df), self._probabilities(F.col("margins")))
        return scored.select(*df.columns, "p_c", "p_s", "p_o", "pred", "confidence")

    def _probabilities(self, margins: Column) -> Column:
        raise NotImplementedError


class LogisticGradeModel(GradeModel):
    """Multinomial logistic regression with balanced class weights, fitted until its derivatives vanish."""

    def fit(self, train: DataFrame, max_iter: int = 1000, tolerance: float = 1e-4) -> LogisticGradeModel:
        rows = self._rows(train, F.lit(0))
        try:
            coefficients, intercepts, self.iterations = fit_softmax(rows, len(GRADES), tolerance, max_iter)
        finally:
            rows.close()
        self._keep(rows.context, coefficients, intercepts)
        return self

    def _probabilities(self, margins: Column) -> Column:
        def shares(m: Column) -> Column:
            e = F.transform(m, lambda x: F.exp(x - F.array_max(m)))
            return let(e, lambda xs: F.transform(xs, lambda x: x / F.aggregate(xs, F.lit(0.0), lambda acc, y: acc + y)))

        return let(margins, shares)


class MarginGradeModel(GradeModel):
    """Support-vector margins turned into probabilities by curves that were fitted on rows their classifier has not seen.

    Rows are dealt into folds by a hash of their key.  For every fold, one classifier per grade is fitted on the other folds
    and a logistic curve on this fold's margins.  A score is the mean over the folds of the curves' values, each fold's
    scaled to sum 1.  So every row helps to fit ``folds`` - 1 classifiers and one set of curves."""

    def fit(self, train: DataFrame, key: str, max_iter: int = 2000, folds: int = 5, tolerance: float = 1e-4) -> MarginGradeModel:
        self.folds = folds
        rows = self._rows(train, fold_of(key, folds))
        try:
            weights, self.iterations = fit_margins(rows, folds, len(GRADES), tolerance, max_iter)
            self.curves = fit_sigmoids(rows, weights, folds, len(GRADES))
            self._keep(rows.context, *rows.spread(weights))
        finally:
            rows.close()
        return self

    def _probabilities(self, margins: Column) -> Column:
        k = len(GRADES)
        each = [1.0 / (1.0 + F.exp(-(F.lit(float(a)) * F.get(margins, F.lit(i)) + F.lit(float(b))))) for i, (a, b) in enumerate(self.curves)]

        def mean(q: Column) -> Column:
            totals = [sum((F.get(q, F.lit(f * k + j)) for j in range(1, k)), F.get(q, F.lit(f * k))) for f in range(self.folds)]
            return F.array(*[
                sum((F.when(t > 0, F.get(q, F.lit(f * k + j)) / t).otherwise(1.0 / k) for f, t in enumerate(totals)), F.lit(0.0)) / self.folds
                for j in range(k)])

        return let(F.array(*each), mean)


def fold_of(key: str, folds: int, seed: int = 42) -> Column:
    """Fold 0 to ``folds`` - 1 of a row by a hash of its key."""
    return F.pmod(F.conv(F.left(split_key(key, seed), F.lit(8)), 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def _width(prepared: DataFrame) -> int:
    """Length of the feature vectors, from the column's metadata."""
    return int(prepared.schema["features"].metadata["ml_attr"]["num_attrs"])


def train_grade_model(
    train: DataFrame, variant: str = "lr_char", key: str = "id", pack: KeywordPack | None = None,
    width: int = 1 << 18, max_iter: int | None = None, tolerance: float = 1e-4,
) -> GradeModel:
    """Variants: ``lr_char`` (logistic on word-bounded n-grams), ``svc_char``, ``svc_char_word``,
    ``svc_char_word_keyword``, ``lr_text_char`` (logistic on whole-text n-grams).  ``max_iter`` is 1000 for logistic and 2000
    for margin models where it is not given."""
    kinds = {
        "lr_char": ("char_wb",), "svc_char": ("char_wb",), "svc_char_word": ("char_wb", "word"),
        "svc_char_word_keyword": ("char_wb", "word"), "lr_text_char": ("char",),
    }[variant]
    with_keywords = pack if variant.endswith("keyword") else None
    # Labelled rows are often few files or one range of a large table: without this one task would fit all of them.
    train = train.repartition(PARTS_PER_CORE * train.sparkSession.sparkContext.defaultParallelism)
    data = keyword_counts(train, with_keywords) if with_keywords is not None else train
    features = fit_features(data, kinds, with_keywords, width=width)
    if variant.startswith("lr"):
        return LogisticGradeModel(features, with_keywords).fit(train, max_iter or 1000, tolerance)
    return MarginGradeModel(features, with_keywords).fit(train, key, max_iter or 2000, tolerance=tolerance)
