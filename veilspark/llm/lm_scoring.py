"""Language-model scoring: bigram counts in a log-frequency Bloom filter, broadcast to the workers or probed shard by shard.

The model interpolates a quantised bigram estimate with smoothed single-word counts,

    P(w | h) = weight * q(h, w) / c(h) + (1 - weight) * P1(w),    P1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),

where q is the lower end of the count's logarithmic bucket, so the estimate stays below one in sum but for the filter's
false positives (about one in 64 unseen pairs of known words).  The first token of a text has no predecessor and takes P1; so does a
token after an unknown word."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veilspark.llm.shared import add_columns, map_batches, release, saved

_END = b" end"  # no word holds a blank
_PROBES = 6
_BITS = 8.7  # bits per insertion, for one false positive in about 64
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)
_RESULTS = "n_tokens bigint, n_known bigint, base_score double, score double"


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _HALF)) * _MIX2
        x = (x ^ (x >> _HALF)) * _MIX2
        return x ^ (x >> _HALF)


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit key of a bigram from its words' hashes."""
    with np.errstate(over="ignore"):
        return _mixed(first * _MIX + second)


class TokenHashes(dict):
    """64-bit hashes of tokens, remembered; cleared when large."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token)
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Tokens of a whole text: words between blanks (space, TAB to CR), A-Z lower-cased, then the end."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        words.append(_END)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _level(count: np.ndarray, base: float) -> np.ndarray:
    """Bucket number of a count, from 1."""
    return (1 + np.floor(np.log(np.maximum(count, 1)) / math.log(base) + 1e-9)).astype(np.int64)


def _value(level: np.ndarray, base: float) -> np.ndarray:
    """Smallest count of a bucket; 0 for level 0."""
    return np.where(level > 0, np.ceil(base ** (level - 1.0) - 1e-9), 0.0)


def _places(key: np.ndarray, level: np.ndarray | int, probe: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        one = _mixed(key + np.uint64(1) * (np.asarray(level).astype(np.uint64) * _MIX))
        return one + np.uint64(probe) * (_mixed(one) | np.uint64(1))


def build_filter(keys: np.ndarray, counts: np.ndarray, base: float) -> np.ndarray:
    """Bits (as bytes) with an entry for every level up to a pair's own."""
    levels = _level(counts, base)
    size = max(64, int(levels.sum() * _BITS) // 8 * 8)
    bits = np.zeros(size, bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        own = keys[levels >= q]
        for j in range(_PROBES):
            bits[(_places(own, q, j) % np.uint64(size)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def probe_levels(bits: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray, shard: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Level of every key: the number of levels found one after another, ``most`` at the most."""
    level = np.zeros(len(keys), np.int64)
    alive, q = np.flatnonzero(most >= 1), 1
    while len(alive):
        for j in range(_PROBES):
            if not len(alive):
                break
            s = shard[alive]
            at = (_places(keys[alive], q, j) % sizes[s]).astype(np.int64) + starts[s]
            alive = alive[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        level[alive] = q
        q += 1
        alive = alive[most[alive] >= q]
    return level


def _counted(parts: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the counts of equal keys over blocks of (keys, counts), folded as they come."""
    keys, counts, waiting = np.empty(0, np.uint64), np.empty(0, np.int64), []

    def fold() -> None:
        nonlocal keys, counts
        k = np.concatenate([keys, *(x for x, _ in waiting)])
        n = np.concatenate([counts, *(x for _, x in waiting)])
        keys, where = np.unique(k, return_inverse=True)
        counts = np.bincount(where, weights=n, minlength=len(keys)).astype(np.int64)
        waiting.clear()

    size = 0
    for p in parts:
        for k, n in zip(p["keys"], p["counts"]):
            waiting.append((np.frombuffer(k, np.uint64), np.frombuffer(n, np.uint32)))
            size += len(waiting[-1][0])
        if size > 1_000_000 + len(keys):
            fold()
            size = 0
    fold()
    return keys, counts


class LanguageModel:
    """Counts over a corpus: ``table``, kind 0 words (keys, counts), 1 bigrams (filter bits), one row per shard; and the totals N and V."""

    def __init__(self, table: DataFrame, shards: int, base: float, weight: float):
        self.table, self.shards, self.base, self.weight = table, shards, base, weight
        row = table.where("kind = 0").agg(F.sum("total"), F.sum("distinct")).first()
        self.tokens, self.types = int(row[0] or 0), int(row[1] or 0)
        # What a broadcast would hold: word hashes with counts, and the filters.
        held = F.when(F.col("kind") == 0, F.col("distinct") * 16).otherwise(F.col("size") / 8)
        self.bytes = int(table.agg(F.sum(held)).first()[0] or 0)


def count_corpus(training: DataFrame, text: str = "text", base: float = 1.5, weight: float = 0.5) -> LanguageModel:
    """Count all words and bigrams of all whole ``training`` texts (null: empty).

    A task counts its own texts in memory, a few million tokens at a time, and hands on sorted blocks of (key, count) per
    hash range, so that a very frequent word leaves each task as one entry.  Ranges grow in number with the input's
    partitions, which bounds what one task merges."""
    shards = 1 << max(4, math.ceil(math.log2(max(1, training.rdd.getNumPartitions()))))
    shift = np.uint64(64 - shards.bit_length() + 1)

    def blocks(kind: int, keys: list[np.ndarray]) -> dict:
        k, n = np.unique(np.concatenate(keys), return_counts=True)
        at = np.searchsorted(k >> shift, np.arange(shards + 1).astype(np.uint64))
        own = [s for s in range(shards) if at[s + 1] > at[s]]
        return {
            "kind": [kind] * len(own), "shard": own, "keys": [k[at[s] : at[s + 1]].tobytes() for s in own],
            "counts": [n[at[s] : at[s + 1]].astype(np.uint32).tobytes() for s in own]}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes, words, pairs, size = TokenHashes(), [], [], 0
        for b in batches:
            for t in b.column(0).to_pylist():
                ids = hashes.of(t)
                words.append(ids)
                pairs.append(pair_key(ids[:-1], ids[1:]))
                size += len(ids)
                if size > 3_000_000:
                    yield blocks(0, words)
                    yield blocks(1, pairs)
                    words, pairs, size = [], [], 0
        if words:
            yield blocks(0, words)
            yield blocks(1, pairs)

    def merge(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = _counted(parts)
        own = {"keys": [None], "counts": [None], "bits": [None], "size": [0]}
        if key[0] == 1:  # of the pairs only the filter is kept
            bits = build_filter(keys, counts, base)
            own |= {"bits": [bits.tobytes()], "size": [8 * len(bits)]}
        else:
            own |= {"keys": [keys.tobytes()], "counts": [counts.tobytes()]}
        yield pd.DataFrame({"kind": [key[0]], "shard": [key[1]], **own, "total": [int(counts.sum())], "distinct": [len(keys)]})

    schema = "kind int, shard int, keys binary, counts binary, bits binary, size bigint, total bigint, distinct bigint"
    table = saved(
        map_batches(training.select(F.col(text).cast("string")), "kind int, shard int, keys binary, counts binary", count)
        .groupBy("kind", "shard").applyInPandas(merge, schema))
    release(training.sparkSession)
    return LanguageModel(table, shards, base, weight)


class _Block:
    """Some whole texts as one run of token hashes."""

    def __init__(self, docs: list[np.ndarray]):
        self.ids = np.concatenate(docs)
        self.ends = np.cumsum([len(d) for d in docs])
        self.begins = self.ends - [len(d) for d in docs]
        self.first = np.zeros(len(self.ids), bool)
        self.first[self.begins] = True
        self.words, self.word_at = np.unique(self.ids, return_inverse=True)

    def pairs(self) -> np.ndarray:
        """Keys of all distinct pairs of neighbours."""
        at = np.flatnonzero(~self.first)
        return np.unique(pair_key(self.ids[at - 1], self.ids[at]))

    def sums(self, counts: np.ndarray, levels: Callable[[np.ndarray, np.ndarray], np.ndarray], model: tuple) -> dict:
        """The result columns, from the counts of ``words`` and a function from pair keys and their highest possible levels to levels."""
        n, v, base, weight = model
        c = counts[self.word_at]
        single = (c + 0.1) / (n + 0.1 * (v + 1))
        has = np.flatnonzero(~self.first[1:] & (c[:-1] > 0) & (c[1:] > 0)) + 1
        pairs, back = np.unique(pair_key(self.ids[has - 1], self.ids[has]), return_inverse=True)
        # A pair is at most as frequent as either of its words: no level beyond counts.
        most = np.zeros(len(pairs), np.int64)
        most[back] = _level(np.minimum(c[has - 1], c[has]), base)
        found = _value(levels(pairs, most), base)[back]
        p = single.copy()
        after = np.flatnonzero(~self.first[1:] & (c[:-1] > 0)) + 1
        p[after] *= 1 - weight
        p[has] += weight * found / c[has - 1]
        return {
            "n_tokens": (self.ends - self.begins).tolist(), "n_known": np.add.reduceat((c > 0).astype(np.int64), self.begins).tolist(),
            "base_score": np.add.reduceat(np.log10(single), self.begins).tolist(), "score": np.add.reduceat(np.log10(p), self.begins).tolist()}


def _look_up(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Counts of ``wanted`` in sorted ``keys``, 0 where absent."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, counts[place], 0).astype(np.int64)


def _broadcast_scores(documents: DataFrame, model: LanguageModel, text: str) -> DataFrame:
    parts: dict = {"keys": [], "counts": [], "bits": [], "starts": np.zeros(model.shards, np.int64), "sizes": np.full(model.shards, 64, np.uint64)}
    at, kind_of_count = 64, np.int64 if model.tokens >= 1 << 32 else np.uint32
    parts["bits"].append(bytes(8))  # an empty shard's filter
    for kind, shard, keys, counts, bits, size in (
        model.table.select("kind", "shard", "keys", "counts", "bits", "size").orderBy("kind", "shard").toLocalIterator()
    ):
        if kind == 0:
            parts["keys"].append(bytes(keys))
            parts["counts"].append(np.frombuffer(counts, np.int64).astype(kind_of_count).tobytes())
        else:
            parts["bits"].append(bytes(bits))
            parts["starts"][shard], parts["sizes"][shard] = at, size
            at += size
    for k in ("keys", "counts", "bits"):
        parts[k] = b"".join(parts[k])
    sent = documents.sparkSession.sparkContext.broadcast(parts)  # ``score_texts`` has checked its size
    del parts
    numbers, shift = (model.tokens, model.types, model.base, model.weight), np.uint64(64 - model.shards.bit_length() + 1)
    column = documents.drop(*T.StructType.fromDDL(_RESULTS).names).columns.index(text)

    def start() -> tuple:
        m = sent.value
        return (TokenHashes(), np.frombuffer(m["keys"], np.uint64), np.frombuffer(m["counts"], kind_of_count), np.frombuffer(m["bits"], np.uint8),
                m["starts"], m["sizes"])

    def fn(b: pa.RecordBatch, state: tuple) -> dict:
        hashes, keys, counts, bits, starts, sizes = state
        out: dict = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        at = 0
        while at < b.num_rows:
            docs, size = [], 0
            while at < b.num_rows and size < 250_000:
                docs.append(hashes.of(b.column(column)[at].as_py()))
                size, at = size + len(docs[-1]), at + 1
            block = _Block(docs)
            found = block.sums(
                _look_up(keys, counts, block.words),
                lambda k, most: probe_levels(bits, starts, sizes, k, (k >> shift).astype(np.int64), most), numbers)
            for k in out:
                out[k] += found[k]
        return out

    return add_columns(documents, _RESULTS, fn, start)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys: the first one, then the steps between them in as many bytes as the longest needs."""
    steps = np.diff(keys)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return keys[:1].astype("<u8").tobytes() + bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[8]
    steps = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(steps) + 1, 8), np.uint8)
    out[0], out[1:, :width] = np.frombuffer(data, np.uint8, 8), steps
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _joined_scores(documents: DataFrame, model: LanguageModel, text: str, block_tokens: int = 3_000_000) -> DataFrame:
    """The same for models too large to broadcast: every block of documents asks each shard once for its distinct words and pairs.

    A shard's task looks the words up and probes the same filter bits; the counts and levels go back, in the order asked, to
    the block's documents.  Blocks are bounded, so neither a frequent pair nor a long table gathers in one task."""
    spark, shards = documents.sparkSession, model.shards
    release(spark)
    new = T.StructType.fromDDL(_RESULTS)
    kept = documents.drop(*new.names)
    column = kept.columns.index(text)
    shift = np.uint64(64 - shards.bit_length() + 1)
    numbers = (model.tokens, model.types, model.base, model.weight)

    def number(b: pa.RecordBatch, numbered: Iterator[int]) -> dict:
        blocks, rows, part, size = [], [], TaskContext.get().partitionId() << 32, block_tokens
        for t in b.column(column):
            if size >= block_tokens:
                block, row, size = part + next(numbered), 0, 0
            blocks.append(block)
            rows.append(row)
            row, size = row + 1, size + len((t.as_py() or "").split()) + 1
        return {"_lm_block": blocks, "_lm_row": rows}

    pinned = saved(add_columns(kept, "_lm_block bigint, _lm_row bigint", number, lambda: iter(range(1 << 32))))
    salts = max(1, math.ceil(documents.rdd.getNumPartitions() / shards))  # a longer table asks every shard in several tasks

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """A piece is what one task reads of a block without a gap; it is named by its first row."""
        hashes, docs, here, piece = TokenHashes(), [], None, 0

        def asked() -> dict:
            block = _Block(docs)
            out: dict = {k: [] for k in ("kind", "shard", "asked")}
            for kind, keys in enumerate((block.words, block.pairs())):
                cut = np.searchsorted(keys >> shift, np.arange(shards + 1).astype(np.uint64))
                own = [s for s in range(shards) if cut[s + 1] > cut[s]]
                out["shard"] += own
                out["kind"] += [kind] * len(own)
                out["asked"] += [_packed(keys[cut[s] : cut[s + 1]]) for s in own]
            n = len(out["shard"])
            return out | {"block": [here] * n, "piece": [piece] * n, "salt": [(here ^ here >> 32) % salts] * n}

        for b in batches:
            for t, block, row in zip(*(b.column(i) for i in range(3))):
                block, row = block.as_py(), row.as_py()
                if docs and (block != here or row != piece + len(docs)):
                    yield asked()
                    docs = []
                if not docs:
                    here, piece = block, row
                docs.append(hashes.of(t.as_py()))
        if docs:
            yield asked()

    def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = []
        row = held.iloc[0] if len(held) else None
        for kind, data in zip(asked["kind"], asked["asked"]):
            keys = _unpacked(data)
            if row is None:
                values = np.zeros(len(keys), np.int64)
            elif kind == 0:
                values = _look_up(np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.int64), keys)
            else:
                values = probe_levels(
                    np.frombuffer(row["bits"], np.uint8), np.zeros(1, np.int64), np.array([row["size"]], np.uint64), keys,
                    np.zeros(len(keys), np.int64), np.full(len(keys), 1 << 15))
            found.append(values.astype(np.int64 if kind == 0 else np.uint16).tobytes())
        return pd.DataFrame({"_lm_block": asked["block"], "piece": asked["piece"], "kind": asked["kind"], "shard": asked["shard"], "found": found})

    def answered() -> DataFrame:
        asked = map_batches(
            pinned.select(text, "_lm_block", "_lm_row"), "block bigint, piece bigint, kind int, shard int, salt int, asked binary", ask)
        held = model.table.select("kind", "shard", "keys", "counts", "bits", "size", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        both = asked.groupBy("kind", "shard", "salt").cogroup(held.groupBy("kind", "shard", "salt"))
        return saved(both.applyInPandas(answer, "_lm_block bigint, piece bigint, kind int, shard int, found binary"))

    answers = answered()
    release(spark)
    arrow = to_arrow_schema(new)

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, rows = TokenHashes(), rows.sort_by("_lm_row")
        docs = [hashes.of(t) for t in rows.column(column).to_pylist()]
        parts: dict = {}
        for piece, kind, _, found in sorted(zip(*(answers.column(k).to_pylist() for k in ("piece", "kind", "shard", "found"))), key=lambda x: x[:3]):
            parts.setdefault(piece, ([], []))[kind].append(found)
        out: dict = {f.name: [] for f in arrow}
        for at, end in zip(parts, [*list(parts)[1:], len(docs)]):
            block = _Block(docs[at:end])
            counts, levels, pairs = np.frombuffer(b"".join(parts[at][0]), np.int64), np.frombuffer(b"".join(parts[at][1]), np.uint16), block.pairs()
            if len(counts) != len(block.words) or len(levels) != len(pairs):
                raise ValueError("the answers do not fit the documents of their block")
            found = block.sums(counts, lambda k, most: np.minimum(levels[np.searchsorted(pairs, k)].astype(np.int64), most), numbers)
            for k in out:
                out[k] += found[k]
        rows = rows.drop_columns(["_lm_block", "_lm_row"])
        return pa.table([*rows.columns, *(pa.array(out[f.name], f.type) for f in arrow)], names=[*rows.column_names, *arrow.names])

    return pinned.groupBy("_lm_block").cogroup(answers.groupBy("_lm_block")).applyInArrow(score, T.StructType([*kept.schema.fields, *new.fields]))


def score_texts(documents: DataFrame, model: LanguageModel, text: str = "text", most_bytes: int = 300_000_000) -> DataFrame:
    """``documents`` with n_tokens, n_known, base_score and score (log10) of every whole text (null: empty, its end alone).

    A model of up to ``most_bytes`` (word counts and filters) is broadcast; of a larger one every shard answers what blocks of
    documents ask.  The same filter decides either way, with the same results.  Rows stay as they are; repeated rows score alike; without training tokens every base score is 0 per token;
    input columns named like a result are replaced."""
    by_broadcast = model.bytes <= most_bytes
    return (_broadcast_scores if by_broadcast else _joined_scores)(documents, model, text)
