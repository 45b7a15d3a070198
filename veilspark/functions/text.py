"""Text helpers as Columns.  Offsets are code points, half-open, like Spark's own string functions."""

from __future__ import annotations

import functools
import unicodedata
from decimal import Decimal

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The white-space characters and the line ends of the texts handled here.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE_CLASS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{SPACE_CLASS}]"
# The same, asked in two steps: a class costs a call for each of its ranges, which nearly all characters are spared.
QUICK_SPACE = rf"[\t-\x20\x{{85}}-\x{{3000}}&&[{SPACE_CLASS}]]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    Besides sharing the value this keeps large array expressions out of generated code: the whole is
    one higher-order function, which Spark interprets instead of unrolling it past the 64 KB limit."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def built_once(make):
    """A function of hashable arguments that gives an expression: built once per session of the JVM.

    Large expressions take thousands of calls to the JVM, seconds in all; they don't depend on a table, only on names."""
    held: dict = {}

    @functools.wraps(make)
    def get(*args):
        key = (id(SparkContext._gateway), *args)
        if key not in held:
            held[key] = make(*args)
        return held[key]

    return get


def rows_of(arr: Column) -> Column:
    """The array as a generator input.  Exploding a bare column makes Catalyst add a ``size > 0`` filter
    and push it down with a second copy of the column's whole expression; an expression prevents it."""
    return F.filter(arr, lambda x: x.isNotNull())


def strip(c: Column) -> Column:
    """Remove leading and trailing white space of every kind (``trim`` alone removes only U+0020)."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def squeeze(c: Column) -> Column:
    """White-space runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, f"{QUICK_SPACE}+", " "))


def drop_space(c: Column) -> Column:
    return F.regexp_replace(c, f"{QUICK_SPACE}+", "")


def lines(c: Column) -> Column:
    """Array of lines; every line-end character of ``LINE_END`` separates."""
    return F.split(unify_line_ends(c), "\n", -1)


# Line ends beside the line feed, asked in two steps like ``QUICK_SPACE``.
_OTHER_LINE_END = r"[\x0b-\x1e\x{85}-\x{2029}&&[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]]"


def unify_line_ends(c: Column) -> Column:
    c = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    return F.when(c.rlike(_OTHER_LINE_END), F.regexp_replace(c, _OTHER_LINE_END, "\n")).otherwise(c)


def cut(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` for 0 <= start <= end."""
    return F.substring(text, start + F.lit(1), end - start)


def quoted(c: Column) -> Column:
    """The text in quotes with escapes, as used inside audit messages."""
    esc = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    esc = F.replace(esc, F.lit("\n"), F.lit("\\n"))
    esc = F.replace(esc, F.lit("\r"), F.lit("\\r"))
    esc = F.replace(esc, F.lit("\t"), F.lit("\\t"))
    single = F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), esc, F.lit('"'))
    return F.when(c.contains("'") & ~c.contains('"'), double).otherwise(single)


def first_chars(c: Column, n: int, ellipsis: bool = True) -> Column:
    short = F.left(c, F.lit(n))
    if not ellipsis:
        return short
    return F.when(F.length(c) <= n, c).otherwise(F.concat(short, F.lit("...")))


def label_with_context(base: Column, context: Column, max_length: int = 30) -> Column:
    """``base: first chars of the flattened context...``; only ``base`` when there is no context."""
    flat = squeeze(context)
    return F.when(F.coalesce(context, F.lit("")) == "", base).otherwise(
        F.concat(base, F.lit(": "), first_chars(flat, max_length))
    )


# Powers of two that turn a double of each size into an exact integer below 2 ** 63.
_SCALES = ((4.0, 55), (2.0 ** -8, 60), (2.0 ** -15, 70), (0.0, 77))


def fixed(x: Column, digits: int) -> Column:
    """``x`` (0 <= x < 256, up to six digits) with a fixed number of decimals, rounded on its exact
    binary value, half to even.

    ``format_string`` and ``round`` work on the shortest decimal form and round halves up, which
    differs on ties."""
    x = x.cast("double")
    factor, unit = F.lit(None).cast("double"), F.lit(None).cast("decimal(24,0)")
    for least, bits in reversed(_SCALES):
        factor = F.when(x >= least, F.lit(2.0 ** bits)).otherwise(factor)
        unit = F.when(x >= least, F.lit(Decimal(2 ** bits)).cast("decimal(24,0)")).otherwise(unit)
    scaled = (x * factor).cast("bigint").cast("decimal(20,0)") * F.lit(10 ** digits).cast("decimal(8,0)")
    whole, rest = F.call_function("div", scaled, unit), (scaled % unit) * F.lit(2).cast("decimal(1,0)")
    n = whole + F.when((rest > unit) | ((rest == unit) & (whole % 2 == 1)), 1).otherwise(0)
    return F.concat(
        F.floor(n / (10 ** digits)).cast("string"), F.lit("."), F.lpad((n % (10 ** digits)).cast("string"), digits, "0"))


def rounded(x: Column, digits: int) -> Column:
    return fixed(x, digits).cast("double")


def hangul_share(c: Column) -> Column:
    """Share of Hangul syllables in the text."""
    return F.length(F.regexp_replace(c, "[^가-힣]", "")) / F.length(c)


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


# Precomposed Hangul, ASCII and Latin-1 letters are already in NFC as long as no combining mark,
# conjoining jamo or compatibility character occurs: those rows never enter Python.
_SURELY_NFC = r"^[\x00-\x{02ff}]*+(?:[\x{0400}-\x{0482}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{2460}-\x{24ff}\x{25a0}-\x{26ff}\x{3000}-\x{3029}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fff}가-힣\x{ff01}-\x{ffee}]++[\x00-\x{02ff}]*+)*+$"


def needs_nfc(c: Column) -> Column:
    return ~c.rlike(_SURELY_NFC)


def nfc(c: Column) -> Column:
    """Unicode NFC.  Spark has no built-in, so text outside the surely normalised ranges goes
    through an Arrow batch function; all other rows only carry a null there."""
    return F.when(needs_nfc(c), _nfc(F.when(needs_nfc(c), c))).otherwise(c)
