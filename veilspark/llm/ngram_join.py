"""N-gram Jaccard join: globally ordered shingle sets, prefix candidates, and a trie walk that shares partial overlaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import add_columns, components, forget, map_batches, narrow, release, saved, sorted_groups

_HEAVY = 1 << 48  # set in the order key of frequent shingles: they come last
_COUNTERS = 1 << 20
_SLICE = 1 << 16
_SPOTS = 1 << 25  # a bit for the ids and classes whose texts are fetched: 4 MB
_SPOT_SLICE = 1 << 21
_BLOCK = 2048  # rows of either side of a bucket that one task compares at a time
_M1, _M2, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


class WordHashes(dict):
    """Hashes of words seen lately: 400,000 words of at most 64 bytes, some 90 MB when full; longer ones are hashed anew."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 400_000:
                self.clear()
            self[word] = value
        return value


def shingle_set(text: str | None, words: WordHashes, n: int = 5) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the n-word shingles of a whole text; fewer words are one shingle."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(own) < n:
        return np.asarray([xxhash.xxh3_64_intdigest(b" ".join(own)) >> 16] if own else [], np.int64)
    ids = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    with np.errstate(over="ignore"):
        s = ids[: len(ids) - n + 1].copy()
        for k in range(1, n):
            s = (s ^ (s >> _HALF)) * _M1 + ids[k : len(ids) - n + 1 + k]
        s = (s ^ (s >> _HALF)) * _M2
        s = (s ^ (s >> _HALF)) * _M2
    return np.unique((s >> np.uint64(16)).astype(np.int64))


def _class(keys: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(keys.tobytes()))))


def _bits(keys: np.ndarray) -> bytes:
    """A bit for each of at least 4 n bins that a set's shingles occupy: bins of one side only bound an overlap."""
    bins = 64
    while bins < 4 * len(keys):
        bins *= 2
    on = np.zeros(bins, np.uint8)
    on[keys & (bins - 1)] = 1
    return np.packbits(on, bitorder="little").tobytes()


def _least_overlap(total: Column | int, percent: int):
    """Smallest overlap of two sets of ``total`` elements together that reaches the similarity."""
    return (percent * total + 99 + percent) // (100 + percent)


def _may_overlap(a: bytes, b: bytes, n_a: int, n_b: int, need: int) -> bool:
    """Every bin that only one side occupies holds at least one element that the other side lacks."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y, n_a, n_b = y, x, n_b, n_a
    if len(x) < len(y):  # low bits of the hash: bins fold by their number
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    lacks = lambda u, v: int(np.bitwise_count(u & ~v).sum())
    return min(n_a - lacks(x, y), n_b - lacks(y, x)) >= need


def _close_pairs(g: dict[str, list], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y) of a bucket's block that sizes, places and occupied bins let pass: x outside of the bucket's main
    component, y in any other than x's."""
    n, i, c, comp, role = (np.asarray(g[k], np.int64) for k in ("n", "i", "c", "component", "role"))
    sizes = np.asarray([len(b) for b in g["bins"]])
    matrix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def folded(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bins of the rows of this size or the next as words of so many bytes, how many are occupied, where a row is."""
        if size not in matrix:
            at = np.flatnonzero((sizes == size) | (sizes == 2 * size))
            words = np.zeros((len(at), size // 8), np.uint64)
            for big in np.unique(sizes[at]):
                own = sizes[at] == big
                rows = np.frombuffer(b"".join(g["bins"][k] for k in at[own]), np.uint64).reshape(-1, big // size, size // 8)
                words[own] = np.bitwise_or.reduce(rows, axis=1)  # low bits of the hash: bins fold by their number
            place = np.zeros(len(n), np.int64)
            place[at] = np.arange(len(at))
            matrix[size] = words, np.bitwise_count(words).sum(axis=1, dtype=np.int64), place
        return matrix[size]

    xs, ys = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    ys = ys[np.argsort(n[ys], kind="stable")]
    out: list[tuple[np.ndarray, np.ndarray]] = [(xs[:0], ys[:0])]
    step = max(1, (1 << 18) // max(1, len(ys)))
    for x in (xs[lo : lo + step] for lo in range(0, len(xs), step)):
        need = _least_overlap(n[x][:, None] + n[ys], percent)
        fits = (n[x] - i[x])[:, None] >= need
        fits &= (n[ys] - i[ys]) >= need
        fits &= comp[x][:, None] != comp[ys]
        fits &= ((role[x][:, None] & role[ys] & 1) == 0) | (c[x][:, None] < c[ys])  # two rows that are both outside meet once
        a, b = np.nonzero(fits)
        need, a, b = need[a, b], x[a], ys[b]
        least = np.minimum(sizes[a], sizes[b])
        far = np.maximum(sizes[a], sizes[b]) > 2 * least  # of such sizes no pair is close enough at usual similarities
        for size in np.unique(least):
            own = np.flatnonzero((least == size) & ~far)
            words, occupied, place = folded(int(size))
            some = max(1, (1 << 20) // words.shape[1])
            for part in (own[lo : lo + some] for lo in range(0, len(own), some)):
                p, q = a[part], b[part]
                both = np.bitwise_count(words[place[p]] & words[place[q]]).sum(axis=1, dtype=np.int64)
                most = np.minimum(n[p] - occupied[place[p]], n[q] - occupied[place[q]]) + both
                keep = most >= need[part]
                out.append((p[keep], q[keep]))
        out += [(a[k : k + 1], b[k : k + 1]) for k in np.flatnonzero(far)
                if _may_overlap(g["bins"][a[k]], g["bins"][b[k]], int(n[a[k]]), int(n[b[k]]), int(need[k]))]
    return tuple(np.concatenate(side) for side in zip(*out))


def trie_links(query: np.ndarray, members: list[tuple[int, np.ndarray]], percent: int) -> list[int]:
    """Ids of ``members`` (id, ordered set) that reach ``percent`` Jaccard with the ordered set ``query``.

    Sorted members are the leaves of a trie in order of a walk; neighbours share the path of their common prefix.  The
    overlap with the query is kept for every depth of the current path, so a shared part is compared once.  A path is
    left as soon as what remains of either side can't bring the overlap to what is needed; then the members below it are
    skipped at the depth where that was seen, if their own need is not smaller."""
    out, path, cum = [], np.empty(0, np.int64), np.zeros(1, np.int64)
    members = sorted(members, key=lambda m: m[1].astype(">i8").tobytes())
    n = len(query)
    for id, keys in members:
        need = int(_least_overlap(n + len(keys), percent))
        if min(n, len(keys)) < need:
            continue
        most = min(len(path), len(keys))
        differ = np.flatnonzero(path[:most] != keys[:most])
        depth = int(differ[0]) if len(differ) else most
        cum = cum[: depth + 1]
        grown = [cum]
        while True:
            overlap = int(grown[-1][-1])
            left = n - (int(np.searchsorted(query, keys[depth - 1], "right")) if depth else 0)
            if overlap + min(len(keys) - depth, left) < need or depth == len(keys):
                break
            step = keys[depth : depth + 128]
            at = np.minimum(np.searchsorted(query, step), n - 1)
            grown.append(overlap + np.cumsum(query[at] == step))
            depth += len(step)
        cum, path = np.concatenate(grown), keys[:depth]
        if depth == len(keys) and cum[-1] >= need:
            out.append(id)
    return out


def _far_enough(percent: int) -> Column:
    """Whether x and y can still reach the similarity if their bucket's element is the first that both share; if it isn't,
    another bucket finds the pair."""
    need = F.floor((percent * (F.col("x.n") + F.col("y.n")) + 99 + percent) / (100 + percent))
    return (F.col("x.n") - F.col("x.i") >= need) & (F.col("y.n") - F.col("y.i") >= need)


def jaccard_components(
    documents: DataFrame, n: int = 5, percent: int = 75, id: str = "doc_id", text: str = "text", heavy_factor: float = 2.5, group: int = 256,
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    See ``linked_classes``.  Null ids link like others but give no component id of their own; repeated rows get equal
    results; extra columns are not returned."""
    rows, classes = linked_classes(documents, n, percent, id, text, heavy_factor, group)
    grouped = rows.join(classes.select("cls", "g"), "cls", "left")
    least = classes.groupBy("g").agg(F.min("rep").alias("least"))
    return grouped.join(least, "g", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, n: int = 5, percent: int = 75, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` that stay when one row of every group of linked texts is kept, all columns as they were.

    Rows are told apart by id and set of shingles: rows that share an id but no shingles are judged each for itself.  A
    group keeps the row with the smallest id; null ids come last, so that one of them stays only where a group has no
    other.  Of rows with the same id and set one stays.  Texts without words link with nothing; of such rows, those with
    equal id and text are one."""
    _, classes = linked_classes(documents, n, percent, id, text)
    cls, own = (next(name for k in range(len(documents.columns) + 1) if (name := f"_{x}{k}") not in documents.columns) for x in ("class", "id"))
    first = F.struct(F.col("rep").isNull().alias("last"), "rep", "cls")
    winners = classes.groupBy("g").agg(F.min(first).alias("w")).select(
        F.col("w.cls").alias(cls), F.coalesce(F.col("w.rep").cast("string"), F.lit("null")).alias(own))
    blank = F.coalesce(F.trim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), F.lit("")) == ""
    place = documents.columns.index(text)

    def classed(b: pa.RecordBatch, words: WordHashes) -> dict:
        return {cls: [_class(shingle_set(t.as_py(), words, n)) for t in b.column(place)]}

    spoken = add_columns(documents.where(~blank), f"{cls} bigint", classed, WordHashes)
    spoken = spoken.withColumn(own, F.coalesce(F.col(id).cast("bigint").cast("string"), F.lit("null")))
    kept = spoken.join(winners, [cls, own], "left_semi").dropDuplicates([cls, own])
    return kept.select(*documents.columns).union(documents.where(blank).dropDuplicates([id, text]))


def linked_classes(
    documents: DataFrame, n: int = 5, percent: int = 75, id: str = "doc_id", text: str = "text", heavy_factor: float = 2.5, group: int = 256,
) -> tuple[DataFrame, DataFrame]:
    """(per document: doc_id, n, cls; per class of equal sets: cls, rep, g): ``g`` names the component of a class by its
    links, ``rep`` is the smallest doc_id of the class.

    Two documents link when 100 * overlap >= ``percent`` * union of their sets of ``n``-word shingles.  All links between
    different sets count; equal sets are one class.

    1. One pass over the texts gives set sizes, classes, occupied bins and, in a fixed number of counters, how frequent
       shingles are.  The global order is by hash with the frequent ones last; any order is exact, this one keeps
       passages that many texts share out of the prefixes.
    2. A second pass emits each class's prefix, the elements one of which any partner must share; those of a single class
       go.  Frequent elements are dealt out in parts.  Of buckets that hold the same classes the first in the order stays:
       in it every class has the most left to share.
    3. In each bucket every class meets eight of the bucket's classes; occupied bins and set sizes rule pairs out, and the
       trie walk decides the rest.  Components follow.  Classes outside a bucket's largest component meet eight classes
       of that one, and then all of the bucket that are in other components: large groups of copies cost a few
       comparisons each, and no link between components is lost.  This last step can have pairs in the square of a
       group of copies; they are ruled out block by block inside the tasks, and only those that pass are written.
    4. Sets are made again from the texts of the few classes in question, not kept for all.  A bit for each of 2^25 hash
       values of ids and classes tells which texts these are (a few more that share a bit do no harm), so no text is shuffled.

    Texts without words are empty sets of no class and link with nothing; an empty table gives no rows.  Shingles are told
    apart by 48-bit hashes, sets by 64-bit ones."""
    source = documents.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def facts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words, seen, counters = WordHashes(), set(), np.zeros(_COUNTERS, np.uint32)
        none = {"doc_id": [], "n": [], "cls": [], "bins": [], "part": [], "counters": []}
        for b in batches:
            out = {k: [] for k in none}
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys = shingle_set(t, words, n)
                cls = _class(keys) if len(keys) else None
                fresh = cls is not None and cls not in seen
                if fresh:
                    seen.add(cls)
                    np.add.at(counters, keys >> 28, np.uint32(1))
                for k, v in zip(none, (doc, len(keys), cls, _bits(keys) if fresh else None, None, None)):
                    out[k].append(v)
            yield out
        parts = [p for p in range(_COUNTERS // _SLICE) if counters[p * _SLICE : (p + 1) * _SLICE].any()]
        m = len(parts)
        yield {"doc_id": [None] * m, "n": [None] * m, "cls": [None] * m, "bins": [None] * m, "part": parts,
               "counters": [counters[p * _SLICE : (p + 1) * _SLICE].tobytes() for p in parts]}

    facts = saved(map_batches(source, "doc_id bigint, n bigint, cls bigint, bins binary, part int, counters binary", facts_of))
    rows = facts.where("part is null").select("doc_id", "n", "cls")
    heavy = _heavy_counters(facts, heavy_factor)
    sent = documents.sparkSession.sparkContext.broadcast(heavy)  # a bit per counter: 128 KB

    def ordered(keys: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(sent.value, np.uint8)
        c = keys >> 28
        late = (bits[c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
        return np.concatenate([keys[~late], keys[late] | _HEAVY])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words, seen = WordHashes(), set()
        for b in batches:
            out: list[list] = [[], [], [], []]
            for t in b.column(1).to_pylist():
                keys = shingle_set(t, words, n)
                cls = _class(keys) if len(keys) else None
                if cls is None or cls in seen:
                    continue
                seen.add(cls)
                p = len(keys) - (percent * len(keys) + 99) // 100 + 1
                for o, v in zip(out, (ordered(keys)[:p], np.full(p, cls), np.full(p, len(keys), np.int32), np.arange(p, dtype=np.int32))):
                    o.append(v)
                if len(out[0]) >= 500:
                    yield dict(zip(("h", "c", "n", "i"), map(np.concatenate, out)))
                    out = [[], [], [], []]
            if out[0]:
                yield dict(zip(("h", "c", "n", "i"), map(np.concatenate, out)))

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Rows of an element that another class has too; in a dealt-out bucket all rows.  One row waits for the next batch."""
        wait, had = None, False
        for b in batches:
            cols = [b.column(k).to_numpy() for k in range(4)]
            if wait is not None:
                cols = [np.concatenate([w, c]) for w, c in zip(wait, cols)]
            h, c = cols[0], cols[1]
            if not len(h):
                continue
            new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
            cols = [x[new] for x in cols]
            h = cols[0]
            same = h[1:] == h[:-1]
            keep = (h >= _HEAVY) | np.r_[had, same] | np.r_[same, False]
            had = bool(same[-1]) if len(same) else had
            wait = [x[-1:] for x in cols]
            keep[-1] = False
            yield dict(zip(("h", "c", "n", "i"), (x[keep] for x in cols)))
        if wait is not None and (had or wait[0][0] >= _HEAVY):
            yield dict(zip(("h", "c", "n", "i"), wait))

    schema = "h bigint, c bigint, n int, i int"
    deal = F.when(F.col("h") >= _HEAVY, F.pmod("c", F.lit(64))).otherwise(0)
    buckets = saved(map_batches(
        map_batches(source, schema, prefixes).repartition("h", deal).sortWithinPartitions("h", "c"), schema, several))
    spark = documents.sparkSession
    release(spark)
    first = buckets.groupBy("h").agg(*[F.bit_xor(F.xxhash64("c", F.lit(k))).alias(f"same_{k}") for k in (1, 2)]).groupBy(
        "same_1", "same_2").agg(F.min("h").alias("h")).select("h")
    shared = saved(narrow(buckets.join(first, "h", "left_semi")))
    forget(buckets)

    classes = saved(facts.where("cls is not null").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.max("n").cast("int").alias("n"), F.first("bins", ignorenulls=True).alias("bins")))

    row = F.struct("n", "c", "i")

    def centres(of: DataFrame, seeds: range) -> DataFrame:
        """Some rows of every bucket: chosen by hash, so that buckets of the same classes choose the same ones."""
        return of.groupBy("h").agg(F.array(*[F.min_by(row, F.xxhash64("c", F.lit(s))) for s in seeds]).alias("y")).select(
            "h", F.explode(F.array_distinct("y")).alias("y"))

    def paired(x: DataFrame, y: DataFrame, further: Column) -> DataFrame:
        return (
            x.join(y, "h").where((F.col("x.c") != F.col("y.c")) & _far_enough(percent) & further)
            .select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()
        )

    met = saved(narrow(centres(shared, range(8))))  # by all classes of their buckets
    done = saved(narrow(paired(shared.select("h", row.alias("x")), met, F.lit(True))))
    links = _verified(done, classes, source, ordered, n, percent, group)
    rest = saved(narrow(shared.join(met.select("h", F.col("y.c").alias("c")), ["h", "c"], "left_anti")))
    for table in (shared, met):
        forget(table)
    for last in (False, True):  # more centres for classes outside a bucket's largest component, then all pairs left
        release(spark)
        comp = components(links)
        labelled = saved(narrow(rest.join(comp.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))))
        per = labelled.groupBy("h", "component").agg(F.count("*").alias("m")).groupBy("h").agg(
            F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("k")).where("k > 1").select("h", "main")
        mixed = saved(narrow(labelled.join(per, "h")))
        if last:
            near = saved(narrow(_near_in_buckets(mixed, classes, percent).join(done, ["a", "b"], "left_anti")))
            found = _linked(near, classes, source, ordered, n, percent, group)
        else:
            outside = mixed.where("component <> main").select("h", F.struct("n", "c", "i", "component").alias("x"))
            pairs = paired(outside, centres(mixed.where("component = main"), range(8, 16)), F.lit(True))
            near = saved(narrow(pairs.join(done, ["a", "b"], "left_anti")))
            found = _verified(near, classes, source, ordered, n, percent, group)
            done = done.union(near)
        links = links.union(found)
        for table in (labelled, mixed):
            forget(table)
    comp = components(links)
    for table in (rest, done, near, links):
        forget(table)
    release(spark)

    named = classes.join(comp.withColumnRenamed("id", "cls"), "cls", "left")
    return rows, named.select("cls", "rep", F.coalesce("component", "cls").alias("g"))


def _heavy_counters(facts: DataFrame, factor: float) -> bytes:
    """A bit per counter whose sum lies far above the mean; sums are made part by part, each of a fixed size."""
    def add(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_SLICE, np.int64)
        for p in parts:
            for c in p["counters"]:
                total += np.frombuffer(c, np.uint32)
        yield pd.DataFrame({"part": [key[0]], "total": [total.tobytes()]})

    sums = np.zeros(_COUNTERS, np.int64)
    table = facts.where("part is not null").select("part", "counters").groupBy("part").applyInPandas(add, "part int, total binary")
    for part, total in table.collect():  # 16 rows of half a megabyte
        sums[part * _SLICE : (part + 1) * _SLICE] = np.frombuffer(total, np.int64)
    return np.packbits(sums > 64 + factor * sums.mean(), bitorder="little").tobytes()


def _near_in_buckets(mixed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a class outside its bucket's main component and one in another component that may link.

    Rows go to tasks with their bins.  Buckets of the same main component, as a large group of copies has many, are put
    together as long as that gives at most four times the comparisons.  What is put together is compared block by block:
    some of the outside classes with some of all; nearly always that is one block."""
    outside = F.col("component") != F.col("main")
    meets = (F.col("x.h") == F.col("y.h")) & (F.col("x.component") != F.col("y.component")) & _far_enough(percent) & (
        (F.col("x.component") != F.col("x.main")) | (F.col("y.component") != F.col("y.main")))
    some = saved(narrow(mixed.alias("x").join(mixed.alias("y"), meets, "left_semi")))  # may link by sizes and places
    counts = (F.count("*").alias("k"), F.sum(outside.cast("int")).alias("o"))
    by_bucket = some.groupBy("main", "h").agg(*counts)
    members = some.select("main", "c", "n", "component").distinct()
    work = by_bucket.groupBy("main").agg(F.sum(F.col("k").cast("double") * F.col("o")).alias("work"))
    together = members.groupBy("main").agg(*counts).join(work, "main").withColumn(
        "whole", F.col("k").cast("double") * F.col("o") <= 4 * F.col("work"))
    row = ("whole", "key", "c", "n", "i", "component", "main", "k", "o")
    rows = members.join(together.where("whole"), "main").withColumn("i", F.lit(0)).withColumn("key", F.col("main")).select(*row).union(
        some.join(together.where("not whole").select("main", "whole"), "main").join(by_bucket, ["main", "h"]).withColumn("key", F.col("h")).select(*row))

    parts = lambda rows: F.ceil(rows / F.lit(_BLOCK)).cast("int")
    place = lambda x, y, role: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(role).alias("role"))
    own = lambda seed, k: F.pmod(F.xxhash64("c", F.lit(seed)), k)
    every = lambda k, at: F.transform(F.sequence(F.lit(0), k - 1), at)
    n_x, n_y = parts(F.greatest("o", F.lit(1))), parts(F.col("k"))
    one = F.array(F.when(outside, place(F.lit(0), F.lit(0), 3)).otherwise(place(F.lit(0), F.lit(0), 2)))
    many = F.concat(
        F.when(outside, every(n_y, lambda y: place(own(1, n_x), y, 1))).otherwise(F.array().cast("array<struct<x:int,y:int,role:int>>")),
        every(n_x, lambda x: place(x, own(2, n_y), 2)))
    block = ("whole", "key", "x", "y")
    sent = rows.withColumn("at", F.explode(F.when((n_x == 1) & (n_y == 1), one).otherwise(many))).select(
        "whole", "key", F.col("at.x").alias("x"), F.col("at.y").alias("y"), F.col("at.role").alias("role"), "c", "n", "i", "component")
    sent = sent.join(classes.select(F.col("cls").alias("c"), "bins"), "c").repartition(*block).sortWithinPartitions(*block)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for g in sorted_groups(batches, block):
            x, y = _close_pairs(g, percent)
            c = np.asarray(g["c"], np.int64)
            yield {"a": np.minimum(c[x], c[y]), "b": np.maximum(c[x], c[y])}

    return map_batches(sent.select(*block, "role", "c", "n", "i", "component", "bins"), "a bigint, b bigint", compare).distinct()


def _spots(wanted: DataFrame) -> bytes:
    """A bit for every value of ``spot`` below 2^25 that ``wanted`` has; parts are of a fixed size."""
    def mark(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(_SPOT_SLICE, np.uint8)
        on[rows["spot"].to_numpy() % _SPOT_SLICE] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    bits = bytearray(_SPOTS // 8)
    at = _SPOT_SLICE // 8
    table = wanted.distinct().withColumn("part", F.floor(F.col("spot") / _SPOT_SLICE)).groupBy("part").applyInPandas(mark, "part bigint, bits binary")
    for part, own in table.collect():  # 16 rows of 256 KB at most
        bits[part * at : (part + 1) * at] = own
    return bytes(bits)


def _verified(pairs: DataFrame, classes: DataFrame, source: DataFrame, ordered: Callable, n: int, percent: int, group: int) -> DataFrame:
    """The links (a, b) among ``pairs`` of classes."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in (batch.slice(lo, 256) for batch in batches for lo in range(0, batch.num_rows, 256)):
            a, z, x, y, m, k = (b.column(i).to_pylist() for i in range(6))
            keep = [i for i in range(len(a)) if _may_overlap(x[i], y[i], m[i], k[i], int(_least_overlap(m[i] + k[i], percent)))]
            yield {"a": [a[i] for i in keep], "b": [z[i] for i in keep]}

    side = lambda k: classes.select(F.col("cls").alias(k), F.col("bins").alias(f"bins_{k}"), F.col("n").alias(f"n_{k}"))
    near = saved(narrow(map_batches(
        pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "bins_a", "bins_b", "n_a", "n_b"), "a bigint, b bigint", bounded)))
    links = _linked(near, classes, source, ordered, n, percent, group)
    forget(near)
    return links


def _linked(near: DataFrame, classes: DataFrame, source: DataFrame, ordered: Callable, n: int, percent: int, group: int) -> DataFrame:
    """The links (a, b) among ``near``, pairs of classes; their sets are made again."""
    if near.isEmpty():
        return near.sparkSession.createDataFrame([], near.schema)
    # Groups around one class, cut into parts of bounded size.
    sizes = near.groupBy("a").agg(F.ceil(F.count("*") / group).alias("parts"))
    members = near.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).select("a", "part", "b")
    members = members.union(members.select("a", "part", F.col("a").alias("b")).distinct())
    wanted = near.select("a").union(near.select("b")).distinct().join(classes.select(F.col("cls").alias("a"), "rep"), "a")
    spot = lambda c: c.bitwiseAND(F.lit(_SPOTS - 1)).alias("spot")
    by_class, by_id = wanted.select(spot(F.col("a"))), wanted.where("rep is not null").select(spot(F.xxhash64("rep")))
    spots = near.sparkSession.sparkContext.broadcast(_spots(by_class.union(by_id)))  # 4 MB

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Rows without an id are known by their sets alone."""
        words, seen, bits = WordHashes(), set(), np.frombuffer(spots.value, np.uint8)
        on = lambda at: (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        for b in batches:
            out: dict = {"b": [], "keys": []}
            at = b.column(0).fill_null(-1).to_numpy()
            for t in b.column(1).take(pa.array(np.flatnonzero((at < 0) | on(at)))):
                keys = shingle_set(t.as_py(), words, n)
                cls = _class(keys) if len(keys) else None
                if cls is not None and cls not in seen and on(np.int64(cls & (_SPOTS - 1))):
                    seen.add(cls)
                    out["b"].append(cls)
                    out["keys"].append(ordered(keys).tobytes())
            yield out

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for g in sorted_groups(batches, ("a", "part")):
            found = {c: np.frombuffer(k, np.int64) for c, k in zip(g["b"], g["keys"])}
            centre = g["a"][0]
            if centre in found:
                query = found.pop(centre)
                hits = trie_links(query, list(found.items()), percent)
                yield {"a": [centre] * len(hits), "b": hits}

    known = source.select(F.when(F.col("doc_id").isNotNull(), spot(F.xxhash64("doc_id"))).alias("spot"), "text")
    made = map_batches(known, "b bigint, keys binary", sets).groupBy("b").agg(F.first("keys").alias("keys"))
    spread = members.join(made, "b").repartition("a", "part").sortWithinPartitions("a", "part")
    return saved(narrow(map_batches(spread.select("a", "part", "b", "keys"), "a bigint, b bigint", walk)))
