"""The de-identification plan: which detections are applied automatically, which need a review, and
which of several overlapping ones wins.

Resolution is order-dependent: a candidate is compared only with the first kept span it overlaps and
the winner takes that span's place, so two kept spans may still overlap.  Spans interact only inside a
run of mutually reaching spans (an island), so the work is split into islands first; each fold then
sees a handful of spans however many a location has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.grades import grade_rank, source_rank, top_grade
from veilspark.functions.rules import REVIEW
from veilspark.functions.text import built_once, let
from veilspark.operators.detection import DETECTION, DETECTIONS, with_location_key

_SLOTTED = DETECTION[:-1] + ",slot:bigint>"


def is_auto(d: Column) -> Column:
    return (
        F.lower(F.coalesce(d["source"], F.lit(""))).isin("regex", "ner")
        & (F.coalesce(d["matched"], F.lit("")) != "")
        & d["start"].isNotNull()
        & d["end"].isNotNull()
    )


def is_review(d: Column) -> Column:
    return (F.lower(F.coalesce(d["source"], F.lit(""))) == "ai") | ~is_auto(d)


def overlaps(a: Column, b: Column) -> Column:
    """Half-open; touching spans and spans with a missing end do not overlap."""
    return F.coalesce((a["start"] < b["end"]) & (b["start"] < a["end"]), F.lit(False))


def _preference(d: Column) -> Column:
    """Smaller is better: source, then grade, then length, then input order."""
    return F.struct(
        source_rank(d["source"]).alias("a"),
        (-grade_rank(d["grade"])).alias("b"),
        (-F.length(F.coalesce(d["matched"], F.lit("")))).alias("c"),
        d["ord"].alias("d"),
    )


def _absorb(kept: Column, lost: Column) -> Column:
    """The kept detection, its reason extended by what it absorbed."""
    note = F.concat(
        F.lit("중복 탐지 흡수: source="), F.coalesce(lost["source"], F.lit("None")),
        F.lit(", label="), F.coalesce(lost["label"], F.lit("None")),
        F.lit(", matched="), F.coalesce(lost["matched"], F.lit("None")),
    )
    old = F.coalesce(kept["reason"], F.lit(""))
    return kept.withField("reason", F.when(old == "", note).otherwise(F.concat(old, F.lit(" / "), note)))


def same_location(a: Column, b: Column) -> Column:
    """Fields decide where both have some, else labels where either has one, else contexts.  This is no equivalence: a span
    without fields can share its place with two that differ in theirs.  ``_m``: digest of the fields; ``_p``: of the label, else
    of the context."""
    return F.when(a["_m"].isNotNull() & b["_m"].isNotNull(), a["_m"] == b["_m"]).otherwise(a["_p"].eqNullSafe(b["_p"]))


def _place(kept: Column, x: Column, meets=overlaps) -> Column:
    """One fold step over the kept spans."""
    def settle(k: Column) -> Column:
        return F.when(_preference(k) <= _preference(x), _absorb(k, x)).otherwise(
            _absorb(x.withField("slot", k["slot"]), k))

    first = F.array_position(F.transform(kept, lambda k: meets(k, x)), F.lit(True))
    return let(first, lambda at: F.when(at == 0, F.concat(kept, F.array(x))).otherwise(
        F.transform(kept, lambda k, i: F.when(i + 1 == at, settle(k)).otherwise(k))))


def _sorted_by(arr: Column, *fields: str) -> Column:
    keyed = F.transform(arr, lambda x: F.struct(*[x[f].alias(f"k{n}") for n, f in enumerate(fields)], x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def _fold(arr: Column, ddl: str, meets=overlaps) -> Column:
    """``arr``: array of ``ddl`` in input order, with a ``slot`` field."""
    return F.aggregate(arr, F.array().cast(f"array<{ddl}>"), lambda kept, x: _place(kept, x, meets))


def _islands(by_start: Column, ddl: str) -> Column:
    """array<array<ddl>>: spans sorted by start, cut wherever a span begins past all earlier ends."""
    none = F.array().cast(f"array<{ddl}>")
    zero = F.struct(
        F.array().cast(f"array<array<{ddl}>>").alias("done"), none.alias("cur"),
        F.lit(None).cast("int").alias("reach"))

    def step(acc: Column, x: Column) -> Column:
        fresh = acc["reach"].isNotNull() & (x["start"] >= acc["reach"])
        return F.struct(
            F.when(fresh, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(fresh, F.array(x)).otherwise(F.concat(acc["cur"], F.array(x))).alias("cur"),
            F.greatest(acc["reach"], x["end"]).alias("reach"),
        )

    return F.aggregate(by_start, zero, step, lambda acc: F.concat(acc["done"], F.array(acc["cur"])))


def _any_overlap(by_start: Column) -> Column:
    return F.exists(
        F.zip_with(by_start, F.slice(by_start, F.lit(2), F.greatest(F.size(by_start), F.lit(1))),
                   lambda a, b: F.coalesce(b["start"] < a["end"], F.lit(False))),
        lambda t: t)


def resolve_overlaps(detections: Column) -> Column:
    """Kept automatic detections of one unit, in slot order."""
    def resolve(auto: Column) -> Column:
        def settle(by_start: Column) -> Column:
            folded = F.flatten(F.transform(
                _islands(by_start, _SLOTTED), lambda isl: _fold(_sorted_by(isl, "ord"), _SLOTTED)))
            # Non-overlapping hits, by far the common case, skip the fold.
            return F.when(_any_overlap(by_start), _sorted_by(folded, "slot")).otherwise(auto)

        return let(_sorted_by(auto, "start", "end", "ord"), settle)

    slotted = F.transform(F.filter(detections, is_auto), lambda d: d.withField("slot", d["ord"]))
    return let(slotted.cast(f"array<{_SLOTTED}>"), resolve)


def _as_targets(arr: Column) -> Column:
    return F.transform(
        arr,
        lambda d: F.struct(
            d["ord"].alias("ord"),
            F.coalesce(d["label"], F.lit("")).alias("label"),
            F.coalesce(d["matched"], F.lit("")).alias("matched"),
            d["grade"].alias("grade"),
            F.when(F.coalesce(d["action"], F.lit("")) == "", REVIEW).otherwise(d["action"]).alias("action"),
            F.coalesce(d["source"], F.lit("")).alias("source"),
            d["start"].alias("start"), d["end"].alias("end"),
            d["sensitive_type"].alias("sensitive_type"),
            d["sensitive_category"].alias("sensitive_category"),
            F.coalesce(d["reason"], F.lit("")).alias("reason"),
        ),
    ).cast(DETECTIONS)


def _display_sorted(arr: Column) -> Column:
    keyed = F.transform(arr, lambda d, i: F.struct(
        d["start"].isNull().alias("a"), d["start"].alias("b"), i.alias("c"), d.alias("d")))
    return F.transform(F.array_sort(keyed), lambda s: s["d"])


def auto_targets(detections: Column) -> Column:
    """Automatic targets of one unit's detections, in display order."""
    return let(detections, lambda d: _display_sorted(_as_targets(resolve_overlaps(d))))


@built_once
def _unit_targets() -> dict[str, Column]:
    has = F.size("detections") > 0
    none = F.array().cast(DETECTIONS)
    return {
        "auto_targets": F.when(has, auto_targets(F.col("detections"))).otherwise(none),
        "review_targets": F.when(has, let(F.col("detections"), lambda d: _display_sorted(_as_targets(F.filter(d, is_review))))).otherwise(none),
    }


def plan_units(detected: DataFrame) -> DataFrame:
    """Row-local plan: ``auto_targets`` and ``review_targets`` next to each unit, both in display
    order.  A unit is one location, so nothing has to move."""
    return detected.withColumns(_unit_targets())


# --- plan over a table of detections ----------------------------------------------------------------

_FIELDS = ["label", "matched", "grade", "action", "source", "start", "end", "sensitive_type",
           "sensitive_category", "reason"]
_EXTRA = ["context", "location_label", "loc"]


#: Offsets of a location that are swept together; a location's runs are at most its length divided by this.
RUN = 65_536


def with_islands(spans: DataFrame, keys: Sequence[str], order: str, run: int = RUN) -> DataFrame:
    """Add ``_island``: the (start, end, ``order``) of the first span of each run of mutually reaching spans.

    A sweep over starts.  A location is cut into runs of offsets, each swept by itself; how far earlier runs reach, and the
    island they leave open, come from one small row per run.  So a location with any number of spans spreads over many
    tasks.  Null key parts are equal."""
    at = F.struct("start", "end", order)
    cut = spans.withColumns({"_k": F.struct(*keys), "_run": F.floor(F.col("start") / F.lit(run))})
    earlier = Window.partitionBy("_k").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    local = Window.partitionBy("_k", "_run").orderBy("start", "end", order)
    reach = cut.groupBy("_k", "_run").agg(F.max("end").alias("_top")).select("_k", "_run", F.max("_top").over(earlier).alias("_far"))
    swept = cut.join(reach, ["_k", "_run"]).withColumn(
        "_reach", F.greatest("_far", F.max("end").over(local.rowsBetween(Window.unboundedPreceding, -1))))
    swept = swept.withColumn("_first", F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), at))
    left_open = swept.groupBy("_k", "_run").agg(F.max("_first").alias("_last")).select("_k", "_run", F.max("_last").over(earlier).alias("_open"))
    return swept.join(left_open, ["_k", "_run"]).withColumn(
        "_island", F.coalesce(F.max("_first").over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_open")
    ).drop("_k", "_run", "_far", "_reach", "_first", "_open")


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


#: Bits that say which documents may have location fields only in part (by hash; 4 KB).
MARKS = 32_768


def _marked(marks: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(marks, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), bit % 8)).cast("int") % 2 == 1


def _swept(auto: DataFrame, *keys: str) -> DataFrame:
    """``_island``: the number of a run of mutually reaching spans among those with equal ``keys``."""
    swept = Window.partitionBy(*keys).orderBy("start", "end", "_o")
    reach = F.max("end").over(swept.rowsBetween(Window.unboundedPreceding, -1))
    return auto.withColumn("_new", F.when(F.col("start") >= reach, 1).otherwise(0)).withColumn(
        "_island", F.sum("_new").over(swept.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def plan_detections(rows: DataFrame, order: Sequence[str] = ("unit_no", "ord"), run: int | None = None, places: bool = True) -> DataFrame:
    """Plan for a table of detections that may come from anywhere: one row per target with ``track``
    (auto or review), ``first_seen`` (order in which the location first appears) and ``slot``.

    Sort by doc_id, track, first_seen, start (nulls last), slot to get the display order.  Spans are folded island by island.
    In documents whose spans have location fields only in part, a place is told pair by pair (``same_location``), and islands
    reach over all their locations.

    By itself each track reads the rows once and deals them by location; of these, documents with fields only in part are dealt
    anew, each to one task.  With ``run`` (``RUN``, for tables in which a location holds very many spans) islands are
    swept in runs of that many offsets (``with_islands``), so no location is one task, and contexts and locations stay out of
    it: each different one of a document is kept once, by its digest, and joined to the targets at the end.  This reads the rows
    several times; give it a stored table.

    Without ``places`` the targets come without loc_key, context, location_label and loc, and no text but that of the
    detections is shuffled: for whoever only counts, grades or lists them."""
    keyed = with_location_key(rows).withColumn("_o", F.struct(*order))
    fields = F.to_json("loc")
    shown = ["loc_key", *_EXTRA] if places else []
    carried = shown if run is None else ["loc_key", "_x"]
    if run is not None:
        keyed = keyed.withColumn("_x", F.sha2(F.to_json(F.struct(*_EXTRA)), 256))
    d = F.struct(*[F.col(f) for f in _FIELDS])
    small = keyed.select(
        "doc_id", _digest(F.col("loc_key")).alias("_at"), "_o", *_FIELDS, *carried, F.when(fields != "{}", _digest(fields)).alias("_m"),
        _digest(F.coalesce(F.concat(F.lit("label:"), "location_label"), F.concat(F.lit("context:"), "context"))).alias("_p"))
    auto, review = small.where(is_auto(d)), small.where(is_review(d)).withColumn("slot", F.col("_o"))
    names = ("_o", *_FIELDS, *carried, "_at", "_m", "_p")
    schema = {f.name: f.dataType.simpleString() for f in auto.select(*names).schema}
    ddl = ("struct<ord:bigint," + ",".join(f"`{n}`:{t}" for n, t in schema.items())
           + f",slot:{schema['_o']}>")

    def kept(islands: DataFrame, group: str) -> DataFrame:
        grouped = islands.groupBy("doc_id", group, "_island").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("items"))
        numbered = F.transform("items", lambda x, i: F.struct(
            i.cast("bigint").alias("ord"), *[x[n].alias(n) for n in schema], x["_o"].alias("slot"))
        ).cast(f"array<{ddl}>")
        return (
            # A span alone on its island, by far the common case, stays as it is.
            grouped.select("doc_id", group, F.explode(F.when(F.size("items") > 1, _fold(numbered, ddl, lambda k, x: overlaps(k, x) & same_location(k, x)))
                                                      .otherwise(numbered)).alias("t"))
            .select("doc_id", *([group] if group == "_at" else []), *[F.col("t")[n].alias(n) for n in (*schema, "slot") if n != group]))

    def placed(targets: DataFrame, track: str, seen: Column) -> DataFrame:
        if run is None:
            return targets.withColumns({"first_seen": seen.over(Window.partitionBy("doc_id", "_at")), "track": F.lit(track)})
        first = targets.groupBy("doc_id", "_at").agg(seen.alias("first_seen")).select(F.struct("doc_id", "_at").alias("_k"), "first_seen")
        return targets.withColumn("_k", F.struct("doc_id", "_at")).join(first, "_k").drop("_k").withColumn("track", F.lit(track))

    seen = F.min_by("_o", "slot")
    if run is None:
        dealt = auto.repartition("doc_id", "_at")
        # The marks ask for every column (``_read``), as the rest does: so Spark shuffles the rows once for both.
        bit = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
        partly = dealt.groupBy("doc_id").agg(
            F.count("_m").alias("_with"), F.count(F.lit(1)).alias("_all"), F.max(F.xxhash64(*small.columns)).alias("_read"),
        ).where("_with > 0 and _with < _all and _read is not null")
        marks = partly.agg(F.bitmap_construct_agg(bit).alias("_marks"))  # one row of fixed size
        marked = dealt.crossJoin(F.broadcast(marks)).withColumn("_partly", _marked(F.col("_marks"), bit)).drop("_marks")
        whole = Window.partitionBy("doc_id")
        known, count = F.count("_m").over(whole), F.count(F.lit(1)).over(whole)
        mixed = marked.where("_partly").withColumn("_group", F.when((known > 0) & (known < count), F.lit(b"")).otherwise(F.col("_at")))
        both = placed(kept(_swept(marked.where("not _partly"), "doc_id", "_at"), "_at"), "auto", seen).unionByName(
            placed(kept(_swept(mixed, "doc_id", "_group"), "_group"), "auto", seen))
    else:
        partly = auto.groupBy(F.struct("doc_id").alias("_d")).agg(F.count("_m").alias("_with"), F.count(F.lit(1)).alias("_all")).where(
            "_with > 0 and _with < _all").select("_d", F.lit(b"").alias("_everywhere"))
        auto = auto.withColumn("_d", F.struct("doc_id")).join(partly, "_d", "left").withColumn("_group", F.coalesce("_everywhere", "_at"))
        both = placed(kept(with_islands(auto, ("doc_id", "_group"), "_o", run), "_group"), "auto", seen)
    both = both.unionByName(placed(review, "review", F.min("_o")))
    if run is not None and places:
        extras = keyed.groupBy("doc_id", "_x").agg(F.first(F.struct(*_EXTRA)).alias("_e")).select(F.struct("doc_id", "_x").alias("_ref"), "_e.*")
        both = both.withColumn("_ref", F.struct("doc_id", "_x")).join(extras, "_ref")
    return both.select(
        "doc_id", *shown[:1], "track", "first_seen", "slot", F.col("_o").alias("order"),
        F.coalesce("label", F.lit("")).alias("label"),
        F.coalesce("matched", F.lit("")).alias("matched"),
        "grade",
        F.when(F.coalesce("action", F.lit("")) == "", REVIEW).otherwise(F.col("action")).alias("action"),
        F.coalesce("source", F.lit("")).alias("source"),
        "start", "end", "sensitive_type", "sensitive_category",
        F.coalesce("reason", F.lit("")).alias("reason"),
        *shown[1:],
    )


def summary_grade(targets: DataFrame) -> DataFrame:
    """Highest grade per document over the targets left in the plan; null without any."""
    return targets.groupBy("doc_id").agg(top_grade(F.col("grade")).alias("summary_grade"))


def source_counts(planned: DataFrame) -> DataFrame:
    """Per document: units, detections by source, automatic and review targets."""
    def n(source: str) -> Column:
        return F.sum(F.size(F.filter("detections", lambda t: t["source"] == source)))

    return planned.groupBy("doc_id").agg(
        F.count("*").alias("units"),
        n("regex").alias("regex_detections"),
        n("ner").alias("ner_detections"),
        n("ai").alias("ai_detections"),
        F.sum(F.size("auto_targets")).alias("auto_targets"),
        F.sum(F.size("review_targets")).alias("review_targets"),
    )
