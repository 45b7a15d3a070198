"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import components, map_batches, saved, sorted_groups


def _tables(count: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables): buckets hold a few vectors on average, and a pair at the threshold shares one with ``recall``."""
    bits = min(62, max(12, math.ceil(math.log2(max(2, count)))))
    agree = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))


def _linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` under the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.95, recall: float = 0.96, block: int = 1024, seed: int = 7,
    id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept.

    Equal vectors are one class, compared once and counted with its number of copies.  Classes that share the signs of a
    table's hyperplanes are candidates; every candidate pair is decided by its cosine in double precision, and counted in
    the first table that joins it.  The number of tables follows from ``recall`` at the threshold; pairs of a higher
    cosine are found with a higher chance.  A bucket above ``block`` classes is dealt out as pairs of blocks, so a hot one
    spreads over many tasks and each holds two blocks at most; what leaves a task is one row per class, not per pair.

    Vectors that are null or empty, zero, or hold null or non-finite parts link with nothing (n_links 0, a component of
    their own); vectors of different lengths are never compared.  Repeated rows of one id count as copies of each other;
    rows of a null id are compared, but have a null component if they are alone."""
    rows = vectors.select(F.col(id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.coalesce((F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(sound, F.transform("v", lambda x: x + F.lit(0.0))))  # -0.0 becomes 0.0
    classes = saved(
        rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        .withColumn("cls", F.xxhash64("v")))
    count = classes.count()
    bits, tables = _tables(count, threshold, recall)

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            out: dict = {k: [] for k in ("cls", "copies", "vec", "sigs")}
            for cls, copies, v in zip(*(b.column(k).to_pylist() for k in range(3))):
                x = np.asarray(v, np.float64)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([seed, len(x)]).standard_normal((tables * bits, len(x)))
                up = (planes[len(x)] @ (x / np.abs(x).max()) > 0).reshape(tables, bits)
                sig = up @ (1 << np.arange(bits, dtype=np.int64)) ^ (len(x) << 40)  # lengths apart
                for k, y in zip(out, (cls, copies, x.tobytes(), sig.astype(np.int64).tolist())):
                    out[k].append(y)
            yield out

    signed = saved(map_batches(classes.select("cls", "copies", "v"), "cls bigint, copies bigint, vec binary, sigs array<bigint>", signs))
    narrow = signed.select("cls", F.posexplode("sigs").alias("t", "sig"))
    sizes = narrow.groupBy("t", "sig").agg(F.count("*").alias("n")).where("n > 1")
    members = (
        narrow.join(sizes, ["t", "sig"]).withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("r", F.pmod(F.hash("cls"), F.col("nb")))
        .withColumn("s", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("cls", "t", "sig", F.least("r", "s").alias("lo"), F.greatest("r", "s").alias("hi"), "r")
    )
    spread = members.join(signed, "cls").repartition("t", "sig", "lo", "hi").sortWithinPartitions("t", "sig", "lo", "hi")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out: dict = {"cls": [], "links": [], "root": []}
        for g in sorted_groups(batches, ("t", "sig", "lo", "hi")):
            lengths = [len(x) for x in g["vec"]]
            for width in set(lengths):  # one, but for chance
                at = [i for i, n in enumerate(lengths) if n == width]
                if len(at) < 2:
                    continue
                x = np.stack([np.frombuffer(g["vec"][i], np.float64) for i in at])
                x = x / np.linalg.norm(x / (big := np.abs(x).max(axis=1, keepdims=True)), axis=1, keepdims=True) / big
                sig = np.asarray([g["sigs"][i] for i in at], np.int64)
                r, cls = np.asarray(g["r"])[at], np.asarray(g["cls"], np.int64)[at]
                copies = np.asarray(g["copies"], np.int64)[at]
                a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
                ok = np.ones(len(a), bool)
                if g["lo"][0] != g["hi"][0]:
                    ok &= r[a] != r[b]
                for t in range(g["t"][0]):
                    ok &= sig[a, t] != sig[b, t]
                a, b = a[ok], b[ok]
                if len(a):
                    links = np.bincount(a, copies[b], len(at)) + np.bincount(b, copies[a], len(at))
                    root = _linked(len(at), a, b)
                    hit = links > 0
                    out["cls"] += cls[hit].tolist()
                    out["links"] += links[hit].astype(np.int64).tolist()
                    out["root"] += cls[root][hit].tolist()
            if len(out["cls"]) > 10_000:
                yield out
                out = {"cls": [], "links": [], "root": []}
        yield out

    found = saved(map_batches(spread, "cls bigint, links bigint, root bigint", compare))
    comp = components(found, "cls", "root")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.select("v", "cls", "rep", "copies").join(links, "cls", "left").join(comp.withColumnRenamed("id", "cls"), "cls", "left")
    known = known.withColumn("group", F.coalesce("component", "cls"))
    least = known.groupBy("group").agg(F.min("rep").alias("least"))
    per_class = known.join(least, "group").select(
        F.col("cls").alias("_cls"), F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "least")
    out = rows.withColumn("_x", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).join(
        per_class, (F.col("_x") == F.col("_cls")) & (F.col("v") == F.col("_v")), "left")
    component = F.coalesce("least", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
