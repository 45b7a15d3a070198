"""Detection rules for an engine without look-around: left context, match and right context are three
groups, and the scan goes on from the last character of a match, so adjacent matches are not lost."""

from __future__ import annotations

_D, _ND = "[0-9]", "[^0-9]"
_W, _NW = "[A-Za-z0-9]", "[^A-Za-z0-9]"
_DASH = "[-–]"
_PHONE_SEP = "[-–·]?"
# Account number layouts, and the driver licence.
_ACCOUNT = (
    "[0-9]{3}-[0-9]{2}-[0-9]{4}-[0-9]{3}|[0-9]{4}-[0-9]{3}-[0-9]{6}|[0-9]{3}-[0-9]{6}-[0-9]{5}|[0-9]{3}-[0-9]{2}-[0-9]{6}"
    "|[0-9]{3}-[0-9]{6}-[0-9]{2}-[0-9]{3}|[0-9]{3}-[0-9]{4}-[0-9]{4}-[0-9]{2}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1}|[0-9]{6}-[0-9]{2}-[0-9]{6}"
    "|[0-9]{4}-[0-9]{2}-[0-9]{7}|[0-9]{3}-[0-9]{6}-[0-9]{3}|[0-9]{2}-[0-9]{2}-[0-9]{6}|[0-9]{3}-[0-9]{2}-[0-9]{6}-[0-9]{1}"
    "|[0-9]{3}-[0-9]{4}-[0-9]{4}-[0-9]{3}|[0-9]{10,14}"
)
_LICENCE = "[0-9]{2}-[0-9]{2}-[0-9]{6}-[0-9]{2}"
_OCTETS = rf"{_D}{{1,3}}\.{_D}{{1,3}}"

# id, label, grade, action, left context, match, right context, keep (1: the scan restarts on the
# last matched character)
BASE = [
    ("rrn", "주민등록번호", "C", "삭제", _ND, f"{_D}{{6}}{_DASH}{_D}{{7}}", _ND, 1),
    ("passport", "여권번호", "C", "삭제", _NW, f"[A-Z]{{1,2}}{_D}{{7,9}}", _NW, 1),
    ("ip", "내부 IP 주소", "C", "삭제", r"[^0-9.]",
     rf"10\.{_D}{{1,3}}\.{_OCTETS}|172\.(?:1[6-9]|2{_D}|3[01])\.{_OCTETS}|192\.168\.{_OCTETS}", r"[^0-9.]", 1),
    ("phone", "전화번호", "S", "마스킹", _ND, f"0{_D}{{1,2}}{_PHONE_SEP}{_D}{{3,4}}{_PHONE_SEP}{_D}{{4}}", _ND, 1),
    ("email", "이메일 주소", "S", "마스킹", r"[^A-Za-z0-9._%+\-]",
     r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", r"[^A-Za-z0-9.\-]", 1),
    ("empid", "사번", "S", "마스킹", _NW, f"[A-Za-z]{{2}}{_D}{{6}}", _NW, 1),
    ("account", "계좌번호", "S", "마스킹", _ND, _ACCOUNT, _ND, 1),
    ("freq", "무선 주파수", "S", "치환", _ND, rf"{_D}{{2,3}}\.{_D}{{3,4}}\s*[MGmg][Hh][Zz]", _NW, 1),
    ("coord", "정밀 위치(키로정)", "S", "범주화", _NW, f"{_D}{{1,3}}[Kk]{_D}{{3}}", _NW, 1),
    ("datetime_precise", "정밀 시각", "S", "범주화", _ND, f"(?:[01]{_D}|2[0-3]):[0-5]{_D}:[0-5]{_D}", _ND, 1),
    ("credit_card", "신용카드번호", "C", "삭제", _ND, r"[-\s]".join([f"{_D}{{4}}"] * 4), _ND, 1),
    ("driver_license", "운전면허번호", "S", "삭제", _ND, _LICENCE, _ND, 1),
    ("vlan_port", "VLAN/포트 정보", "C", "삭제", _NW,
     rf"[Vv][Ll][Aa][Nn]\s*{_D}+|[Pp][Oo][Rr][Tt]\s*{_D}{{2,5}}", _ND, 1),
]
EXTRA = [
    ("ip_masked", "마스킹 IP", "S", "마스킹", "", rf"{_D}+\*\.{_D}+\*(?:\.{_D}+\*?)*", "", 0),
    ("ip_any", "IP 주소", "S", "마스킹", _ND, rf"{_OCTETS}\.{_OCTETS}", r"[^0-9.]", 1),
    ("phone_repr", "대표번호", "S", "마스킹", _ND, f"1{_D}{{3}}{_DASH}{_D}{{4}}", _ND, 1),
    ("phone_area_bracket", "지역번호 괄호식 전화", "S", "마스킹", _ND, rf"0{_D}{{1,2}}\)\s*{_D}{{3,4}}{_DASH}{_D}{{4}}", _ND, 1),
    ("account_like", "계정 후보", "S", "마스킹", "", r"(?i:계정|ID|아이디)\s*[:：=]\s*[A-Za-z][A-Za-z0-9_.-]{2,}", "", 0),
    ("password_like", "비밀번호 후보", "S", "마스킹", "", r"(?i:비밀번호|password|passwd|pwd)\s*[:：=]\s*\S+", "", 0),
]


def hits_cte(units: str, rules: list[tuple] | None = None, key: str = "doc_id, unit_no") -> str:
    """Recursive scan: CTE ``hits``(key, rid, rule, label, grade, action, hit_start, hit_end, value) over
    the CTE ``units`` (key, text)."""
    rules = BASE if rules is None else rules
    table = ",\n".join(
        f"({i}, '{r[0]}', '{r[1]}', '{r[2]}', '{r[3]}', '({r[4]})({r[5]})({r[6]})', {r[7]})" for i, r in enumerate(rules))
    start = "\nUNION ALL\n".join(
        f"SELECT {key}, {i} AS rid, chr(10) || text || chr(10) AS rest, 0::BIGINT AS base FROM {units} "
        f"WHERE regexp_matches(chr(10) || text || chr(10), '({r[4]})({r[5]})({r[6]})')"
        for i, r in enumerate(rules))
    return f"""
rules(rid, rule, label, grade, action, pat, keep) AS (VALUES {table}),
seeds AS ({start}),
scan AS (
  SELECT {key}, rid, rest, base, NULL::VARCHAR AS value, NULL::BIGINT AS hit_start FROM seeds
  UNION ALL
  SELECT {key}, rid,
         substr(rest, pos + pre + length(v) - keep) AS rest,
         base + pos + pre + length(v) - keep - 1 AS base,
         v AS value, base + pos + pre - 2 AS hit_start
  FROM (
    SELECT s.*, r.keep, length(regexp_extract(s.rest, r.pat, 1)) AS pre, regexp_extract(s.rest, r.pat, 2) AS v,
           strpos(s.rest, regexp_extract(s.rest, r.pat, 0)) AS pos
    FROM scan s JOIN rules r ON s.rid = r.rid
    WHERE regexp_matches(s.rest, r.pat)
  ) m
),
hits AS (
  SELECT {key}, s.rid, r.rule, r.label, r.grade, r.action, value, CAST(hit_start AS INTEGER) AS hit_start,
         CAST(hit_start + length(value) AS INTEGER) AS hit_end
  FROM scan s JOIN rules r ON s.rid = r.rid WHERE value IS NOT NULL
)"""
