"""Pattern hits with offsets, computed inside the row: no shuffle, no Python.

``regexp_extract_all`` yields the values.  Each start is where the text holds the value; where it holds one more than
once, ``split`` on the same pattern gives the gaps in between, and a running sum of both lengths each start.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.rules import IDENTIFIER_RULES, MINING_RULES, Rule
from veilspark.functions.text import let

HIT = "struct<rule:string,label:string,value:string,start:int,`end`:int,grade:string,action:string,desc:string>"
HITS = f"array<{HIT}>"

# None of these rules can match without a decimal digit or an @ sign; other rules are always tried.
_GATE = r"(?U)[\d@]"
_GATED = frozenset(r for r in (*IDENTIFIER_RULES, *MINING_RULES) if r.id not in ("account_like", "password_like"))


def _split_rules(rules: Sequence[Rule]) -> tuple[list[Rule], list[Rule]]:
    """(rules behind the gate, rules always tried).  Hits follow rule order, so the gate only covers a
    leading stretch of the rules."""
    n = next((i for i, r in enumerate(rules) if r not in _GATED), len(rules))
    return list(rules[:n]), list(rules[n:])


def no_hits() -> Column:
    return F.array().cast(HITS)


def _located(value: Column, text: Column, after: Column | None = None) -> Column:
    """Place of ``value`` (from 1, 0 where there is none), or of the next one beyond the place ``after``."""
    return F.call_function("locate", value, text, *([] if after is None else [after + F.lit(1)]))


def _pieces(text: Column, rule: Rule) -> Column:
    """struct<values,gaps> of one rule; null where the rule does not hit.  A value that the text holds once needs no gaps: it is
    where it is found."""
    def cut(values: Column) -> Column:
        repeated = F.exists(values, lambda v: _located(v, text, _located(v, text)) > 0)
        return F.when(F.size(values) > 0, F.struct(
            values.alias("values"), F.when(repeated, F.split(text, rule.java, -1)).alias("gaps")))

    return let(F.regexp_extract_all(text, F.lit(rule.java), F.lit(0)), cut)


def _spans(text: Column, pieces: Column) -> Column:
    """array<struct<value,start>> in text order.  Values found more than once are placed by the running length of what came
    before."""
    zero = F.struct(
        F.lit(0).alias("pos"), F.array().cast("array<struct<value:string,start:int>>").alias("out")
    )

    def step(acc: Column, p: Column) -> Column:
        start = acc["pos"] + F.length(p["gap"])
        return F.struct(
            (start + F.length(p["value"])).alias("pos"),
            F.concat(acc["out"], F.array(F.struct(p["value"].alias("value"), start.alias("start")))).alias("out"),
        )

    # The gap after the last match has no value and adds nothing.
    zipped = F.arrays_zip(pieces["gaps"].alias("gap"), pieces["values"].alias("value"))
    folded = F.aggregate(F.filter(zipped, lambda p: p["value"].isNotNull()), zero, step, lambda acc: acc["out"])
    return F.when(pieces["gaps"].isNotNull(), folded).otherwise(F.transform(
        pieces["values"], lambda v: F.struct(v.alias("value"), (_located(v, text) - 1).alias("start"))))


def _described(rules: Sequence[Rule]) -> Column:
    """The rules' fixed fields as a literal array."""
    def text(v: str) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return F.expr("array(" + ", ".join(
        "named_struct(" + ", ".join(
            f"'{n}', {text(v)}" for n, v in (
                ("rule", r.id), ("label", r.label), ("grade", r.grade), ("action", r.action), ("desc", r.desc))) + ")"
        for r in rules) + ")")


def _hits_of(text: Column, rules: Sequence[Rule]) -> Column:
    """Hits of all given rules, each rule's pieces turned into hits by one shared expression."""
    about = _described(rules)

    def per_rule(pieces: Column, n: Column) -> Column:
        r = F.get(about, n)
        return F.transform(_spans(text, pieces), lambda s: F.struct(
            r["rule"].alias("rule"), r["label"].alias("label"), s["value"].alias("value"), s["start"].alias("start"),
            (s["start"] + F.length(s["value"])).alias("end"), r["grade"].alias("grade"), r["action"].alias("action"),
            r["desc"].alias("desc")))

    each = F.transform(F.array(*[_pieces(text, r) for r in rules]), per_rule)
    return F.flatten(F.filter(each, lambda h: h.isNotNull()))


def may_hit(text: Column, rules: Sequence[Rule]) -> Column:
    """Compiled prefilter: true for every row on which some rule hits."""
    gated, free = _split_rules(rules)
    cond = F.lit(False)
    for r in gated:
        cond = cond | text.rlike(r.java)
    cond = text.rlike(_GATE) & cond
    for r in free:
        cond = cond | text.rlike(r.java)
    return cond


def _all_hits(text: Column, rules: Sequence[Rule]) -> Column:
    gated, free = _split_rules(rules)
    parts = F.when(text.rlike(_GATE), _hits_of(text, gated)).otherwise(no_hits()) if gated else no_hits()
    return F.concat(parts, _hits_of(text, free)) if free else parts


def pattern_hits(text: Column, rules: Sequence[Rule]) -> Column:
    """All hits of all rules: rule order first, then position."""
    return let(text, lambda t: _all_hits(t, rules))


def identifier_hits(
    text: Column, base: Sequence[Rule], extra: Sequence[Rule], check_base: bool = True
) -> Column:
    """Base hits, then those extra hits whose exact span is not taken yet.

    ``check_base=False`` compares the extra hits only with each other (the first mining policy).
    Sorting by span brings equal spans together, so each hit only looks at its neighbour."""
    def tagged(hits: Column, further: bool) -> Column:
        return F.transform(hits, lambda h, i: F.struct(
            h["start"].alias("s"), h["end"].alias("e"), F.lit(further).alias("x"), i.alias("i"), h.alias("h")))

    def same_span(a: Column, b: Column) -> Column:
        return F.coalesce((a["s"] == b["s"]) & (a["e"] == b["e"]), F.lit(False))

    def first_of_span(hits: Column) -> Column:
        return let(F.array_sort(hits), lambda hs: F.filter(
            hs, lambda h, i: ~h["x"] | ~same_span(F.get(hs, i - 1), h)))

    def in_order(hits: Column) -> Column:
        keyed = F.transform(hits, lambda h: F.struct(h["x"].alias("x"), h["i"].alias("i"), h["h"].alias("h")))
        return F.transform(F.array_sort(keyed), lambda h: h["h"])

    found, more = tagged(pattern_hits(text, base), False), tagged(pattern_hits(text, extra), True)
    if check_base:
        return let(in_order(first_of_span(F.concat(found, more))), lambda h: h)
    return let(in_order(F.concat(found, first_of_span(more))), lambda h: h)
