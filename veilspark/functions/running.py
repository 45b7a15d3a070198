"""Exact running values over one long group without one long task.

A group (a document, say) that is longer than a run is cut at quantiles of its sequence: equal numbers of rows, whatever the
values are (positions, timestamps, numbers with gaps).  Each run is reduced to one small row, the running value over those
rows gives each run's offset or carry-in, and the rows themselves are windowed per run.  A document holding a third of all
rows is thus spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = 65_536
CUTS = 128


def _place(df: DataFrame, seq: str) -> Column | None:
    """The sequence as a double, in the same order; None for types that have no numbers."""
    kind = df.schema[seq].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(seq).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(seq).cast("timestamp").cast("double")
    return F.col(seq).cast("double") if isinstance(kind, T.NumericType) else None


def with_runs(df: DataFrame, keys: Sequence[str], seq: str, run: int = RUN, cuts: int = CUTS) -> DataFrame:
    """Add ``_k`` (the key parts as a struct: null parts compare as equal) and ``_run``: rows of one group and run can be
    ordered by themselves, later runs have later sequences.

    Groups of more than ``run`` rows are cut at ``cuts`` quantiles; one small row for each such group is joined.  Rows of
    equal sequence share a run.  A group whose sequence has no numbers is one run."""
    cut = df.withColumn("_k", F.struct(*keys))
    place = _place(df, seq)
    if place is None:
        return cut.withColumn("_run", F.lit(0))
    marks = cut.groupBy("_k").agg(
        F.count("*").alias("_rows"), F.percentile_approx(place, [i / cuts for i in range(1, cuts)], 10 * cuts).alias("_marks")
    ).where(F.col("_rows") > run).select("_k", "_marks")
    inside = F.size(F.filter("_marks", lambda m: m <= F.col("_seq")))
    return cut.withColumn("_seq", place).join(marks, "_k", "left").withColumn(
        "_run", F.when(F.col("_marks").isNull(), 0).otherwise(inside)).drop("_marks", "_seq")


def numbered(
    df: DataFrame, keys: Sequence[str], seq: str, name: str, counts: Column | None = None, run: int = RUN, kind: str = "int"
) -> DataFrame:
    """Add ``name``: how many rows of the group up to and including this one count, minus one (so the
    first is 0).  ``counts`` (boolean) says which rows count; default all."""
    one = F.lit(1) if counts is None else F.when(counts, 1).otherwise(0)
    cut = with_runs(df.withColumn("_one", one), keys, seq, run)
    local = Window.partitionBy("_k", "_run").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_k").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy("_k", "_run").agg(F.sum("_one").alias("_n"))
        .select("_k", "_run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        cut.withColumn("_at", F.sum("_one").over(local))
        .join(offsets, ["_k", "_run"])
        .withColumn(name, (F.col("_before") + F.col("_at") - 1).cast(kind))
        .drop("_k", "_run", "_one", "_at", "_before")
    )


def last_before(
    df: DataFrame, keys: Sequence[str], seq: str, value: Column, name: str, run: int = RUN
) -> DataFrame:
    """Add ``name``: the last non-null ``value`` of an earlier row of the group."""
    cut = with_runs(df.withColumn("_v", value), keys, seq, run)
    local = Window.partitionBy("_k", "_run").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_k").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(seq)))
    carry = (
        cut.groupBy("_k", "_run").agg(latest.alias("_last"))
        .select("_k", "_run", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    )
    return (
        cut.withColumn("_local", F.last("_v", ignorenulls=True).over(local))
        .join(carry, ["_k", "_run"])
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop("_k", "_run", "_v", "_local", "_carry")
    )


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank", parts: int = 128, sample: int = 8192) -> DataFrame:
    """Add ``name``: the position (from 1) of each row in the order of these columns (nulls first), over the whole table.

    Rows are dealt into ``parts`` ranges, counted and numbered range by range; the offsets are one row per range.  Range
    bounds come from at most ``sample`` rows, those with the smallest hashes: they balance the ranges, the ranks are exact
    with any bounds.  Rows that are equal in all columns are numbered in no certain order."""
    held = df.withColumn("_key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    kind = held.schema["_key"].dataType
    drawn = held.select("_key").orderBy(F.xxhash64("_key")).limit(sample).orderBy("_key").collect()
    bounds = [r[0] for r in drawn[len(drawn) // parts :: max(1, len(drawn) // parts)]]
    marks = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kind.fields)]) for b in bounds]
    place = F.size(F.filter(F.array(*marks), lambda m: m <= F.col("_key"))) if marks else F.lit(0)
    held = held.withColumn("_range", place)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    offsets = held.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    return held.withColumn("_at", local).join(F.broadcast(offsets), "_range").withColumn(
        name, F.col("_before") + F.col("_at")).drop("_key", "_range", "_at", "_before")


def smallest_by_hash(
    df: DataFrame, hashed: str, quota: Column, by: str | None = None, domain: Sequence[str] = (), digits: int = 4
) -> DataFrame:
    """Mark with ``chosen`` the ``quota`` rows that have the smallest hash (hex text, evenly spread),
    within each value of ``by`` where given.  ``quota`` is an expression over the row count ``_total``.

    A histogram of the leading hex digits finds the bucket in which each quota ends; only that
    bucket's rows are ranked, everything else is decided by its bucket.  The cut table has one row
    per value of ``domain``, which bounds what is broadcast."""
    group = F.lit("") if by is None else F.col(by)
    b = df.withColumns({"_g": group, "_b": F.left(F.col(hashed), F.lit(digits))})
    whole = Window.partitionBy("_g")
    cuts = (
        b.where(F.col("_g").isin(*(domain if by is not None else [""])))
        .groupBy("_g", "_b").agg(F.count("*").alias("_n"))
        .withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_upto", F.sum("_n").over(whole.orderBy("_b")))
        .withColumn("_quota", quota)
        .where((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota")))
        .select("_g", F.col("_b").alias("_cut"), (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_left"))
    )
    j = b.join(F.broadcast(cuts), "_g", "left")
    sure = j.where(F.col("_cut").isNull() | (F.col("_b") != F.col("_cut"))).withColumn(
        "chosen", F.coalesce(F.col("_b") < F.col("_cut"), F.lit(False)))
    edge = (
        j.where(F.col("_b") == F.col("_cut"))
        .withColumn("_rn", F.row_number().over(Window.partitionBy("_g", "_b").orderBy(hashed)))
        .withColumn("chosen", F.col("_rn") <= F.col("_left"))
        .drop("_rn")
    )
    return sure.unionByName(edge).drop("_g", "_b", "_cut", "_left")
