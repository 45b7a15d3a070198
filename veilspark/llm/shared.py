"""Helpers of this subpackage: folders that all executors share, Arrow row maps, connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``.  Only where that is unset (tests on one machine) a local one is made."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.llm.folder", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.llm.folder", base)
    return os.path.join(base, f"llm-{uuid.uuid4().hex}")


def saved(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written to a shared folder and read back: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, per_core: int = 4) -> DataFrame:
    """A table of ids in a few partitions for every core of the cluster: it is written in that many files, however many the
    shuffle before it has.  (Every new file costs an executor a process on some file systems.)"""
    return df.coalesce(max(1, per_core * df.sparkSession.sparkContext.defaultParallelism))


def forget(df: DataFrame) -> None:
    """Delete a table made by ``saved`` once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if "/llm-" in folder:
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have Spark's context cleaner delete the shuffle files of finished queries: it follows the driver's garbage collection,
    which by itself may not come for half an hour.  Plans are let go in a first collection, their shuffles in a second."""
    gc.collect()
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.5)


def map_batches(df: DataFrame, schema: T.StructType | str, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """``fn`` turns Arrow batches into dicts of columns of ``schema``."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, added: str, fn: Callable[[pa.RecordBatch], dict], before: Callable | None = None) -> DataFrame:
    """Every row with the columns ``added`` (DDL) that ``fn`` computes per batch; input columns of those names are replaced.

    ``before`` runs once per task and its result is passed to ``fn`` as second argument."""
    new = T.StructType.fromDDL(added)
    kept = df.drop(*new.names)
    schema = T.StructType([*kept.schema.fields, *new.fields])
    arrow, names = to_arrow_schema(new), kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = before() if before else None
        for b in batches:
            out = fn(b, state) if before else fn(b)
            made = [pa.array(out[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*names, *arrow.names])

    return kept.mapInArrow(run, schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """Groups of equal ``keys`` of rows that come sorted by them, as lists per column; one group is held at a time."""
    held: dict[str, list] = {}
    last = None
    for b in batches:
        rows = b.to_pydict()
        own = list(zip(*(rows[k] for k in keys)))
        lo = 0
        while lo < len(own):
            hi = lo + 1
            while hi < len(own) and own[hi] == own[lo]:
                hi += 1
            if held and own[lo] != last:
                yield held
                held = {}
            if not held:
                held, last = {c: [] for c in rows}, own[lo]
            for c in rows:
                held[c] += rows[c][lo:hi]
            lo = hi
    if held:
        yield held


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable over ``edges``; ids without an edge are absent.

    Alternating large-star and small-star rounds; every round is one written table, and no adjacency is gathered: the
    minimum per vertex is an aggregate and neighbours are joined to it."""
    cur = saved(narrow(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct()
    ))
    before = None
    while not cur.isEmpty():
        # Large star: every larger neighbour is linked to the vertex's minimum.
        both = cur.select("v", "u").union(cur.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        # Small star: every smaller neighbour and the vertex itself are linked to the minimum of the smaller ones.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
            .union(least.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        )
        new = saved(narrow(small))
        state = new.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        forget(cur)
        cur = new
        if state == before:
            break
        before = state
    return cur.select(F.col("v").alias("id"), F.col("u").alias("component")).union(
        cur.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
