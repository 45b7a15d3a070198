"""Keyword packs and matching.

A pack is configuration: role -> keywords, read from a YAML/JSON file or given as a mapping.  It is
small by nature and becomes a literal in the plan; nothing is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.text import drop_space

# Keyword roles and their tracks.
ROLE_TRACKS = {
    "strong_procedural": "C",
    "ambiguous_action": "ambiguous",
    "operational_anchor": "anchor",
    "s_business_sensitive": "S",
    "weak": "weak",
}
MATCH = "array<struct<kw:string,track:string,`group`:string,role:string>>"

# Full-width forms U+FF01..U+FF5E sit 0xFEE0 above their ASCII counterparts.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def normalized(c: Column) -> Column:
    """Full-width to half-width, all white space removed, lower case."""
    return F.lower(drop_space(F.translate(c, _WIDE, _NARROW)))


def normalize_keyword(kw: str) -> str:
    return "".join(kw.translate(str.maketrans(_WIDE, _NARROW)).split()).lower()


@dataclass(frozen=True)
class KeywordPack:
    """Keywords by role; for the first mining policy additionally grouped C keywords."""

    roles: Mapping[str, Sequence[str]] = field(default_factory=dict)
    c_groups: Mapping[str, Sequence[str]] = field(default_factory=dict)
    s_group: Sequence[str] = ()

    def rows(self) -> list[tuple[str, str, str, str, str]]:
        """(role, track, group, keyword, normalised keyword)."""
        out = [(r, ROLE_TRACKS[r], r, kw, normalize_keyword(kw))
               for r in ROLE_TRACKS for kw in self.roles.get(r, ())]
        out += [("c_track", "C", g, kw, normalize_keyword(kw)) for g, kws in self.c_groups.items() for kw in kws]
        out += [("s_track", "S", "S", kw, normalize_keyword(kw)) for kw in self.s_group]
        return out


def pack_from_config(config: Mapping) -> KeywordPack:
    """Pack from the configuration layouts: role based (``ai_tracks`` and ``weak``) or the older one
    (``c_track`` groups, ``s_track``, ``weak``)."""
    def kws(node) -> list[str]:
        return list((node or {}).get("keywords", []) or [])

    tracks = config.get("ai_tracks") or {}
    roles = {r: kws(tracks.get(r)) for r in ROLE_TRACKS if r != "weak"}
    roles["weak"] = kws(config.get("weak"))
    return KeywordPack(
        roles=roles,
        c_groups={g: kws(n) for g, n in (config.get("c_track") or {}).items()},
        s_group=kws(config.get("s_track")),
    )


def role_matches(norm: Column, pack: KeywordPack, role: str) -> Column:
    """Matched keywords of a role, longest first; of keywords equal after normalisation the first."""
    seen: dict[str, str] = {}
    for kw in sorted(pack.roles.get(role, ()), key=lambda k: len(normalize_keyword(k)), reverse=True):
        n = normalize_keyword(kw)
        if n and n not in seen:
            seen[n] = kw
    return _matches(norm, [(kw, n, ROLE_TRACKS[role], role, role) for n, kw in seen.items()])


def _matches(norm: Column, entries: Sequence[tuple[str, str, str, str, str | None]]) -> Column:
    if not entries:
        return F.array().cast(MATCH)
    table = F.array(*[
        F.struct(F.lit(n).alias("n"), F.lit(kw).alias("kw"), F.lit(track).alias("track"),
                 F.lit(group).alias("group"), F.lit(role).cast("string").alias("role"))
        for kw, n, track, group, role in entries])
    return F.transform(
        F.filter(table, lambda k: F.contains(norm, k["n"])),
        lambda k: F.struct(k["kw"].alias("kw"), k["track"].alias("track"), k["group"].alias("group"),
                           k["role"].alias("role"))).cast(MATCH)


def grouped_matches(norm: Column, pack: KeywordPack) -> tuple[Column, Column]:
    """(strong, weak) matches of the first mining policy, in configuration order."""
    strong = [(kw, normalize_keyword(kw), "C", g, None) for g, kws in pack.c_groups.items() for kw in kws]
    strong += [(kw, normalize_keyword(kw), "S", "S", None) for kw in pack.s_group]
    weak = [(kw, normalize_keyword(kw), "weak", "weak", None) for kw in pack.roles.get("weak", ())]
    return _matches(norm, strong), _matches(norm, weak)
