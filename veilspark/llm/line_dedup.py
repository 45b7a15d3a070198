"""Reversible line deduplication: an exact table of references, fronted by sharded cuckoo filters."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.shared import add_columns, map_batches, saved

_BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line without blanks (space, TAB to CR) at both ends, A-Z lower-cased."""
    return line.strip(_BLANKS).lower()


def _digest(key: bytes, shortest: int) -> bytes | None:
    long = len(key) >= shortest and (key.isascii() or len(key.decode("utf-8", "replace")) >= shortest)
    return xxhash.xxh3_128_digest(key) if long else None


class CuckooFilter:
    """Cuckoo filter of 16-bit fingerprints, four to a bucket, over 128-bit keys.

    ``add`` and ``remove`` are exact inverses for keys that were added; ``in`` never misses an added key and errs for
    about one other key in 8,000.  A key that finds no place in 500 moves goes to a small exact overflow set."""

    SLOTS = 4

    def __init__(self, capacity: int, data: bytes | None = None):
        self.overflow: list[bytes] = []
        if data is None:
            self.buckets = 1 << max(1, math.ceil(math.log2(max(capacity, 8) / self.SLOTS / 0.84)))
            self.cells = array("H", bytes(2 * self.SLOTS * self.buckets))
        else:
            n, left = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
            self.buckets, self.cells = n, array("H", data[16 : 16 + 2 * self.SLOTS * n])
            rest = data[16 + 2 * self.SLOTS * n :]
            self.overflow = [rest[16 * i : 16 * i + 16] for i in range(left)]

    def to_bytes(self) -> bytes:
        return self.buckets.to_bytes(8, "little") + len(self.overflow).to_bytes(8, "little") + self.cells.tobytes() + b"".join(self.overflow)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        one = int.from_bytes(key[:8], "little") % self.buckets
        return mark, one, self._other(one, mark)

    def _other(self, place: int, mark: int) -> int:
        return place ^ (mark * 0x5BD1E995 % self.buckets)  # the number of buckets is a power of two

    def _find(self, place: int, mark: int) -> int:
        for i in range(self.SLOTS * place, self.SLOTS * place + self.SLOTS):
            if self.cells[i] == mark:
                return i
        return -1

    def __contains__(self, key: bytes) -> bool:
        mark, one, two = self._places(key)
        return self._find(one, mark) >= 0 or self._find(two, mark) >= 0 or key in self.overflow

    def add(self, key: bytes) -> None:
        mark, one, two = self._places(key)
        for place in (one, two):
            free = self._find(place, 0)
            if free >= 0:
                self.cells[free] = mark
                return
        moves, place = [], two
        for step in range(500):
            i = self.SLOTS * place + (mark + step) % self.SLOTS
            moves.append((i, self.cells[i]))
            mark, self.cells[i] = self.cells[i], mark
            place = self._other(place, mark)
            free = self._find(place, 0)
            if free >= 0:
                self.cells[free] = mark
                return
        for i, old in reversed(moves):
            self.cells[i] = old
        self.overflow.append(key)

    def remove(self, key: bytes) -> None:
        if key in self.overflow:
            self.overflow.remove(key)
            return
        mark, one, two = self._places(key)
        i = max(self._find(one, mark), self._find(two, mark))
        if i >= 0:
            self.cells[i] = 0


def references(documents: DataFrame, shortest: int = 40, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_id): one row per document and key of at least ``shortest`` code points; no row for a null id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            keys, ids = [], []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {_digest(line_key(x), shortest) for x in (t or "").encode("utf-8", "surrogatepass").split(b"\n")} - {None}
                keys += own
                ids += [doc] * len(own)
            yield {"key": keys, "doc_id": ids}

    return map_batches(
        documents.where(F.col(id).isNotNull()).select(F.col(id).cast("bigint"), F.col(text).cast("string")),
        "key binary, doc_id bigint", run)


class LineIndex:
    """References of lines to documents that can be added and taken back.

    State: the exact table ``refs`` (key, doc_id) and one cuckoo filter per shard over its distinct keys.  A new batch's
    distinct keys probe the filters, shard by shard; only those that may be known are joined to the exact table.
    ``delete`` removes the references of documents and, from the filters, every key that has lost its last one; afterwards
    results are as if these documents had never come.  Every step is a written table in the shared folder."""

    def __init__(self, spark: SparkSession, shortest: int = 40, min_docs: int = 5, keys_per_shard: int = 500_000):
        self.spark, self.shortest, self.min_docs, self.keys_per_shard = spark, shortest, min_docs, keys_per_shard
        self.shards = 1
        self.refs: DataFrame | None = None
        self.filters: DataFrame | None = None

    def _shard(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.shards))

    def _rebuild(self, keys: DataFrame, total: int) -> None:
        """Filters over ``keys`` (distinct), as many shards as their number asks for."""
        self.shards = max(1, math.ceil(total / self.keys_per_shard))

        def build(group: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = list(group)
            f = CuckooFilter(sum(map(len, parts)))
            shard = int(parts[0]["shard"].iloc[0])
            for p in parts:
                for k in p["key"]:
                    f.add(bytes(k))
            yield pd.DataFrame({"shard": [shard], "filter": [f.to_bytes()], "n": [sum(map(len, parts))]})

        self.filters = saved(
            keys.select("key", self._shard().alias("shard")).groupBy("shard")
            .applyInPandas(build, "shard bigint, filter binary, n bigint"))

    def _maybe_known(self, keys: DataFrame) -> DataFrame:
        """Of distinct ``keys`` those that the filters hold, with the filters' rare errors."""

        def probe(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(held):
                return keys[["key"]].iloc[:0]
            f = CuckooFilter(0, held["filter"].iloc[0])
            return keys.loc[[bytes(k) in f for k in keys["key"]], ["key"]]

        return keys.withColumn("shard", self._shard()).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(probe, "key binary")

    def insert(self, documents: DataFrame, id: str = "doc_id", text: str = "text") -> LineIndex:
        """Add documents; references that are there already (a document added twice) are not added again."""
        batch = references(documents, self.shortest, id, text)
        if self.refs is None:
            # A first batch has no known key.  Rows of one doc_id are one document.
            self.refs = saved(batch.distinct())
        else:
            batch = saved(batch.distinct())
            maybe = self._maybe_known(batch.select("key").distinct())
            known = self.refs.join(maybe, "key", "left_semi")
            self.refs = saved(self.refs.union(batch.join(known, ["key", "doc_id"], "left_anti")))
        self.counts = saved(self.refs.groupBy("key").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")))
        self._rebuild(self.counts.select("key"), self.counts.count())
        return self

    def delete(self, doc_ids: DataFrame, id: str = "doc_id") -> LineIndex:
        """Take documents back; ids that were never added change nothing."""
        gone = doc_ids.select(F.col(id).cast("bigint").alias("doc_id")).distinct()
        before, self.refs = self.refs, saved(self.refs.join(gone, "doc_id", "left_anti"))
        touched = before.join(gone, "doc_id", "left_semi").select("key").distinct()
        lost = touched.join(self.refs, "key", "left_anti").withColumn("shard", self._shard())

        def drop(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter(0, held["filter"].iloc[0])
            for k in keys["key"]:
                f.remove(bytes(k))
            return pd.DataFrame({"shard": held["shard"], "filter": [f.to_bytes()], "n": held["n"] - len(keys)})

        self.filters = saved(lost.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(
            drop, "shard bigint, filter binary, n bigint"))
        self.counts = saved(self.refs.groupBy("key").agg(F.count("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")))
        return self

    def dedup(self, documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """``documents`` with ``text`` without the lines whose key at least ``min_docs`` indexed documents hold, unless this is
        the largest doc_id holding it; also n_lines (before) and n_dropped.

        All lines of such a key stay in the keeper.  A null or empty text is one empty line and comes back empty; rows of a
        null id lose nothing; repeated rows are treated alike; other columns pass through, those named like a result are
        replaced.  A hot line's references are split by the engine's skewed join; what one document loses is bounded by
        its own lines, so the gathered lists are too."""
        drops = self.counts.where(F.col("n_docs") >= self.min_docs).select("key", "keeper")
        own = self.refs.join(drops, "key").where(F.col("doc_id") < F.col("keeper")).groupBy("doc_id").agg(
            F.collect_set("key").alias("_drop"))
        joined = documents.drop("_drop", "n_lines", "n_dropped").join(
            own.withColumnRenamed("doc_id", "_doc"), F.col(id) == F.col("_doc"), "left").drop("_doc")
        columns, shortest = joined.columns, self.shortest
        at, drop_at = columns.index(text) - 0, columns.index("_drop")
        order = [c for c in columns if c != text]
        joined = joined.select(*[F.col(f"`{c}`") for c in order], F.col(text).cast("string").alias("_text"))
        at, drop_at = len(order), order.index("_drop")

        def fn(b: pa.RecordBatch) -> dict:
            out: dict = {text: [], "n_lines": [], "n_dropped": []}
            for t, drop in zip(b.column(at).to_pylist(), b.column(drop_at).to_pylist()):
                lines = (t or "").encode("utf-8", "surrogatepass").split(b"\n")
                kept = lines
                if drop:
                    drop = set(drop)
                    kept = [x for x in lines if _digest(line_key(x), shortest) not in drop]
                out[text].append(b"\n".join(kept).decode("utf-8", "surrogatepass"))
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(len(lines) - len(kept))
            return out

        done = add_columns(joined, f"`{text}` string, n_lines bigint, n_dropped bigint", fn)
        names = [*[c for c in columns if c != "_drop"], "n_lines", "n_dropped"]
        return done.select(*[F.col(f"`{c}`") for c in names])


def dedup_lines(documents: DataFrame, shortest: int = 40, min_docs: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One batch: index ``documents`` and remove their repeated lines (see ``LineIndex``)."""
    return LineIndex(documents.sparkSession, shortest, min_docs).insert(documents, id, text).dedup(documents, id, text)


