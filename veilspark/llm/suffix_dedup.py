"""Deduplication of long repeated byte strings over sampled positions and direct hashes, in place of prefix doubling over all.

Every string of ``length`` bytes has its sampled position, the 16 bytes of smallest hash in it; copies of the string have
the same one.  Spark sorts these positions by the rank of their 16 bytes; those of one document alone are unique and go.
The rest are ranked again by about twice that length, to the left and to the right, and go when unique; what is left is
past the threshold after one more step, where the strings of full length are compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import add_columns, forget, map_batches, release, saved

_GRAM = 16
_M1, _M2, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every run of ``width`` values."""
    span = 1
    while 2 * span <= width:
        x, span = pick(x[:-span], x[span:]), 2 * span
    return pick(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def sampled_runs(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(position, first, last, rank): the strings that start at first..last have their smallest 16-byte hash at position.

    Every start of a string of ``length`` bytes is in one run; of equal hashes in a string the leftmost counts, so equal
    strings have their position at the same place."""
    n, width = len(data), length - _GRAM + 1
    if n < length:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64)
    padded = np.frombuffer(data + bytes(16), np.uint8)
    words = np.empty(n - 7, "<u8")
    for r in range(8):
        words[r::8] = np.frombuffer(padded, "<u8", count=len(words[r::8]), offset=r)
    with np.errstate(over="ignore"):
        h = (words[:-8] ^ (words[:-8] >> _HALF)) * _M1 + words[8:]
        h = (h ^ (h >> _HALF)) * _M2
        h = (h ^ (h >> _HALF)) * _M2
        h ^= h >> _HALF
    least = _sliding(h, width, np.minimum)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    last = np.r_[first[1:], len(least)] - 1
    done: list[tuple] = []
    while len(first):
        at, wrong = first.copy(), np.flatnonzero(h[first] != least[first])
        while len(wrong):  # at most to the end of the string
            at[wrong] += 1
            wrong = wrong[h[at[wrong]] != least[first[wrong]]]
        done.append((at, first, np.minimum(last, at), h[at]))
        more = last > at  # equal hashes in a row: the next one has the strings that start after this one
        first, last = at[more] + 1, last[more]
    return tuple(map(np.concatenate, zip(*done)))


def _spread(h: np.ndarray, d: np.ndarray, w: np.ndarray) -> dict:
    """Of a rank's rows the first and the last document's go by rank; those between are known to be shared (~w) and go anywhere."""
    order = np.lexsort((d, h))
    h, d, w = h[order], d[order], w[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    ends = np.r_[starts[1:], len(h)]
    sure = np.repeat(d[starts] != d[ends - 1], ends - starts)
    sure[starts] = sure[ends - 1] = False
    at = np.flatnonzero(sure)
    with np.errstate(over="ignore"):
        h[at] = ((d[at].view(np.uint64) + w[at].view(np.uint64)) * _M1).view(np.int64)
    w[at] = ~w[at]
    return {"h": h, "d": d, "w": w}


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Of rows (h, d, w) sorted by h and d those whose h has more than one d; only a first document's rows wait."""
    held, last, known = None, None, False
    for b in batches:
        cols = [b.column(k).to_numpy() for k in range(3)]
        sure = cols[2] < 0
        yield {"d": cols[1][sure], "w": ~cols[2][sure]}
        cols = [x[~sure] for x in cols]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        h, d, w = cols
        if not len(h):
            continue
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        ends = np.r_[starts[1:], len(h)]
        multi = d[starts] != d[ends - 1]
        multi[0] |= known and h[0] == last
        keep = np.repeat(multi, ends - starts)
        yield {"d": d[keep], "w": w[keep]}
        last, known = h[-1], bool(multi[-1])
        held = None if known else [x[starts[-1] :] for x in cols]


def _runs_by_rank(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows (r, c, d, a, m) sorted by r, c and d: a run c of a later document is covered whole (``open`` false).

    That of the first document is open if its rank r has other runs, and else goes; its rows wait until that is known."""
    r0 = c0 = d0 = None
    multi0, held = False, None
    for b in batches:
        r, c, d, a, m = (b.column(k).to_numpy() for k in range(5))
        sure = m < 0
        yield {"d": d[sure], "a": a[sure], "m": -m[sure], "open": np.zeros(int(sure.sum()), bool)}
        r, c, d, a, m = (x[~sure] for x in (r, c, d, a, m))
        if not len(r):
            continue
        on = r0 is not None and r[0] == r0
        same_c = on and c[0] == c0
        new_r = np.r_[not on, r[1:] != r[:-1]]
        new_c = new_r | np.r_[not same_c, c[1:] != c[:-1]]
        run = np.cumsum(new_c)  # 0: goes on from the batch before
        firsts = np.r_[d0 if same_c else 0, d[new_c]]
        covered = d > firsts[run]
        starts = np.flatnonzero(np.r_[True, new_r[1:]])
        ends = np.r_[starts[1:], len(r)]
        kinds = np.add.reduceat(new_c.astype(np.int64), starts)
        multi = kinds > 1
        if on:
            multi[0] = multi0 or kinds[0] > 0
            if held is not None and multi[0]:
                yield {**dict(zip(("d", "a", "m"), held)), "open": np.ones(len(held[0]), bool)}
                held = None
        if not on or len(starts) > 1:
            held = None
        opened = ~covered & np.repeat(multi, ends - starts)
        out = covered | opened
        yield {"d": d[out], "a": a[out], "m": m[out], "open": opened[out]}
        if not multi[-1]:
            tail = np.flatnonzero(~covered[starts[-1] :]) + starts[-1]
            rest = [x[tail] for x in (d, a, m)]
            held = rest if held is None else [np.concatenate(x) for x in zip(held, rest)]
        r0, c0, d0, multi0 = r[-1], c[-1], firsts[run[-1]], bool(multi[-1])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Of rows (name, d, a) sorted by name and d those of later documents than the name's first (~a: known to be one)."""
    name0 = first0 = None
    for b in batches:
        name, d, a = (b.column(k).to_numpy() for k in range(3))
        sure = a < 0
        yield {"d": d[sure], "a": ~a[sure]}
        name, d, a = (x[~sure] for x in (name, d, a))
        if not len(name):
            continue
        on = name0 is not None and name[0] == name0
        new = np.r_[not on, name[1:] != name[:-1]]
        firsts = np.r_[first0 if on else 0, d[new]]
        least = firsts[np.cumsum(new)]
        yield {"d": d[d > least], "a": a[d > least]}
        name0, first0 = name[-1], least[-1]


def _kept(df: DataFrame) -> DataFrame:
    """``saved``, and the shuffle files behind it given back."""
    out = saved(df)
    release(df.sparkSession)
    return out


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def remove_repeats(documents: DataFrame, length: int = 50, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``documents``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary).

    Removed is each byte covered by a string of ``length`` bytes (at least 32) that also starts in a document of a smaller
    id; strings are judged on the input and never cross documents.  Texts are UTF-8; kept bytes may cut characters.  Null
    and empty texts have no bytes; rows of a null id lose nothing and are no source; repeated rows of one id are one
    document.  Extra columns are not returned.

    Rows of one rank that a task knows to be shared are dealt out anywhere, so a hot passage does not fill one task, and
    no task holds more of a group than its first document's rows.  A run of strings that a smaller document has too is
    covered whole by its 64-bit hash; only a run's first document compares it string by string with other runs of its
    rank.  Tables and shuffle files are given back once used, and texts are read again rather than kept."""
    if not 32 <= length < 4096:
        raise ValueError("length must be from 32 to 4095")
    source = documents.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    half = (length - _GRAM) // 2

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out: list[list] = [[], [], []]
        size = 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, first, last, h = sampled_runs((t or "").encode("utf-8", "surrogatepass"), length)
                packed = at << 24 | (at - first) << 12 | (at - last)
                for o, x in zip(out, (h.view(np.int64), np.full(len(at), d, np.int64), packed)):
                    o.append(x)
                size += len(at)
                if size > 200_000:
                    yield _spread(*map(np.concatenate, out))
                    out, size = [[], [], []], 0
        if size:
            yield _spread(*map(np.concatenate, out))

    ranked = map_batches(source.where(F.col("doc_id").isNotNull()), "h bigint, d bigint, w bigint", sample)
    shared = _kept(map_batches(ranked.repartition("h").sortWithinPartitions("h", "d"), "d bigint, w bigint", _several))

    def with_texts(found: DataFrame, *columns: str) -> DataFrame:
        """doc_id, text and the document's own rows of ``found`` as a list."""
        item = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
        own = found.groupBy(F.col("d").alias("doc_id")).agg(F.collect_list(item).alias("found"))
        return source.join(own, "doc_id").select("doc_id", "text", "found")

    def next_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Per position and side the rank of twice the length and the run of strings that hold it."""
        seen: dict = {}
        for b in batches:
            out: dict = {k: [] for k in ("r", "c", "d", "a", "m")}
            for d, t, packed in zip(*(b.column(k).to_pylist() for k in range(3))):
                data = (t or "").encode("utf-8", "surrogatepass")
                for w in set(packed):
                    p = w >> 24
                    first, last = p - (w >> 12 & 4095), p - (w & 4095)
                    for lo, hi, at in ((first, min(last, p - half), p - half), (max(first, p - half + 1), last, p)):
                        if lo > hi or hi + length > len(data):
                            continue
                        c, m = _hash(data[lo : hi + length]), hi - lo + 1
                        r = _hash(data[at : at + half + _GRAM])
                        least = seen.setdefault(c, d)
                        if least < d:
                            r, m = c ^ (d * 0x9E3779B97F4A7C15 + lo & (1 << 63) - 1), -m
                        elif least > d:
                            seen[c] = d
                        for k, v in zip(out, (r, c, d, lo, m)):
                            out[k].append(v)
                if len(seen) > 500_000:
                    seen.clear()
            yield out

    runs = map_batches(with_texts(shared, "w"), "r bigint, c bigint, d bigint, a int, m int", next_ranks)
    found = _kept(map_batches(
        runs.repartition("r").sortWithinPartitions("r", "c", "d"), "d bigint, a int, m int, open boolean", _runs_by_rank))
    forget(shared)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: dict = {}
        for b in batches:
            out: dict = {"name": [], "d": [], "a": []}
            for d, t, own in zip(*(b.column(k).to_pylist() for k in range(3))):
                data = (t or "").encode("utf-8", "surrogatepass")
                starts = {s for x in own for s in range(x["a"], x["a"] + x["m"])}
                for s in starts:
                    name, a = _hash(data[s : s + length]), s
                    least = seen.setdefault(name, d)
                    if least < d:
                        name, a = name ^ (d * 0x9E3779B97F4A7C15 + s & (1 << 63) - 1), ~s
                    elif least > d:
                        seen[name] = d
                    out["name"].append(name)
                    out["d"].append(d)
                    out["a"].append(a)
                if len(seen) > 500_000:
                    seen.clear()
            yield out

    full = map_batches(with_texts(found.where("open"), "a", "m"), "name bigint, d bigint, a int", strings)
    partly = _kept(map_batches(full.repartition("name").sortWithinPartitions("name", "d"), "d bigint, a int", _later))
    edges = found.where("not open").select("d", "a", (F.col("a") + F.col("m") + length - 1).alias("b")).union(
        partly.select("d", "a", (F.col("a") + length).alias("b")))
    spans = edges.groupBy("d").agg(F.collect_list(F.struct("a", "b")).alias("_spans"))  # at most a document's own
    joined = source.join(spans.withColumnRenamed("d", "doc_id"), "doc_id", "left").select("doc_id", "text", "_spans")

    def cut(b: pa.RecordBatch) -> dict:
        out: dict = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        spans = b.column(2)
        for i, t in enumerate(b.column(1).to_pylist()):
            data = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)
            gone, n_spans = np.zeros(len(data), bool), 0
            if spans[i].is_valid:
                edges = np.zeros(len(data) + 1, np.int64)
                pairs = spans[i].values
                a, z = (np.minimum(pairs.field(k).to_numpy(), len(data)) for k in (0, 1))
                np.add.at(edges, a, 1)
                np.add.at(edges, z, -1)
                gone = np.cumsum(edges)[:-1] > 0
                n_spans = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1))
            for k, v in zip(out, (len(data), int(gone.sum()), n_spans, data[~gone].tobytes())):
                out[k].append(v)
        return out

    return add_columns(joined, "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary", cut).drop("text", "_spans")
