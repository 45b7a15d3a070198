"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without ``://`` or for null: empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the rule that decides, else null) and ``verdict``.

    ``rules``: host, path, verdict.  A rule fits its host and all subdomains if the url's path starts with the rule's.
    The longest rule string wins; at equal length the longer host, then ``block``.  Rules with a null part are ignored.

    Each distinct url (so one hot url or a repeated row is worked on once) is expanded into its host suffixes, at most as
    many labels as any rule has, times its path prefixes, of the lengths that rules have.  Expressions meet the rules by
    the first 32 bits of their SHA-256; the full digest then confirms.  Rows, repeated ones too, all stay; null, empty and
    malformed urls have empty host and path and get ``default``; input columns named like a result are replaced."""
    rules = rules.select("host", "path", "verdict").dropna().distinct().withColumns({
        "rule": F.concat("host", "path"), "digest": F.sha2(F.concat("host", "path"), 256)})
    # Bounded: lengths of paths that occur in rules, and one number.
    shape = rules.agg(F.collect_set(F.length("path")), F.max(F.size(F.split("host", r"\.")))).first()
    lengths, labels = sorted(shape[0]), shape[1] or 0
    urls = pages.select(F.col(url).alias("_url")).distinct().withColumns({"_h": host_of(F.col("_url")), "_p": path_of(F.col("_url"))})
    parts = F.split("_h", r"\.")
    hosts = F.expr(
        f"transform(sequence(1, least({labels}, size(_parts))), i -> array_join(slice(_parts, size(_parts) - i + 1, i), '.'))")
    prefixes = F.expr(f"transform(filter(array({', '.join(map(str, lengths)) or '0'}), n -> n <= length(_p)), n -> left(_p, n))")
    if not lengths:
        judged = urls.select("_url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    else:
        judged = (
            urls.withColumn("_parts", parts).withColumn("_host", F.explode(hosts)).withColumn("_path", F.explode(prefixes))
            .withColumn("_digest", F.sha2(F.concat("_host", "_path"), 256))
            .join(rules.withColumn("short", F.left("digest", F.lit(8))), F.left("_digest", F.lit(8)) == F.col("short"))
            .where((F.col("_digest") == F.col("digest")) & (F.col("_host") == F.col("host")))
            .groupBy("_url").agg(F.max_by(
                F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("host"), (F.col("verdict") == "block"))).alias("_best"))
            .select("_url", "_best.rule", "_best.verdict")
        )
    kept = pages.drop("host", "path", "rule", "verdict")
    return (
        kept.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
        .join(judged, F.col(url) == F.col("_url"), "left").drop("_url")
        .withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    )
