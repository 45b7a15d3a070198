"""The same results in plain SQL, for an engine without Spark's functions."""

from __future__ import annotations

from veilspark_checks import derived as D
from veilspark_checks.patterns_sql import BASE, EXTRA, hits_cte

ORACLES: dict[str, str] = {}

# --- inputs ---------------------------------------------------------------------------------------------

LINES = """
raw_lines AS (SELECT doc_id, unnest(list_zip(range(len(ls)), ls)) AS z
              FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
lines AS (SELECT doc_id, z[1]::BIGINT AS unit_no, z[2] AS text FROM raw_lines WHERE trim(z[2]) <> '')"""
CONTACTS = f"contacts AS (SELECT c_nationkey::BIGINT AS doc_id, c_custkey AS unit_no, {D.CONTACT_TEXT} AS text FROM customer)"
NOTES = f"notes AS (SELECT c_nationkey::BIGINT AS doc_id, c_custkey AS unit_no, {D.NOTE_TEXT} AS text FROM customer)"
CONVERSATIONS = "talks AS (SELECT conv_id AS doc_id, turn AS unit_no, text FROM conversations)"

_GRADE_RANK = "CASE grade WHEN 'C' THEN 3 WHEN 'S' THEN 2 WHEN 'O' THEN 1 ELSE 0 END"


def _identified(units: str) -> str:
    """hits of all rules, further ones only where their span is free."""
    n = len(BASE)
    return hits_cte(units, BASE + EXTRA) + f""",
ranked AS (SELECT *, CASE WHEN rid < {n} THEN 1 ELSE row_number() OVER (
             PARTITION BY doc_id, unit_no, hit_start, hit_end ORDER BY rid, hit_start) END AS rn FROM hits),
identified AS (SELECT * FROM ranked WHERE rn = 1)"""


def _hit_select(source: str) -> str:
    return f"""SELECT doc_id, unit_no, CAST(row_number() OVER (PARTITION BY doc_id, unit_no ORDER BY rid, hit_start) - 1 AS INTEGER) AS ord,
       rule, label, hit_start, hit_end, value, grade, action FROM {source}"""


ORACLES["document_hits"] = f"WITH RECURSIVE {LINES},{hits_cte('lines')} {_hit_select('hits')}"
ORACLES["document_identifiers"] = f"WITH RECURSIVE {LINES},{_identified('lines')} {_hit_select('identified')}"
ORACLES["conversation_identifiers"] = f"WITH RECURSIVE {CONVERSATIONS},{_identified('talks')} {_hit_select('identified')}"
ORACLES["contact_hits"] = f"WITH RECURSIVE {CONTACTS},{hits_cte('contacts')} {_hit_select('hits')}"
ORACLES["contact_identifiers"] = f"WITH RECURSIVE {CONTACTS},{_identified('contacts')} {_hit_select('identified')}"
ORACLES["rule_hits_by_language"] = f"""
WITH RECURSIVE whole AS (SELECT doc_id, 0::BIGINT AS unit_no, text FROM documents),{_identified('whole')}
SELECT d.lang, i.rule, count(*) AS hits FROM identified i JOIN documents d USING (doc_id) GROUP BY ALL"""
ORACLES["document_grades"] = f"""
WITH RECURSIVE {CONTACTS},{hits_cte('contacts')}
SELECT c.doc_id, CASE max(coalesce({_GRADE_RANK}, 0)) WHEN 3 THEN 'C' WHEN 2 THEN 'S' ELSE 'O' END AS grade, count(h.rid) AS hits
FROM contacts c LEFT JOIN hits h USING (doc_id, unit_no) GROUP BY c.doc_id"""

# --- names and classifier ------------------------------------------------------------------------------------

NAMES = """names AS (SELECT c_nationkey::BIGINT AS doc_id, c_custkey AS unit_no,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'B-PER' WHEN 2 THEN 'PS' WHEN 3 THEN 'ORG' WHEN 4 THEN 'per' ELSE '인명' END AS entity_group,
  CASE WHEN c_custkey % 2 = 0 THEN 'I-PERSON' END AS entity, c_name AS word,
  CAST(CASE WHEN c_custkey % 11 <> 0 THEN 3 END AS INTEGER) AS s,
  CAST(CASE WHEN c_custkey % 13 = 0 THEN 5 ELSE 3 + length(c_name) END AS INTEGER) AS e,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey % 100) / 100.0::DOUBLE END AS score FROM customer)"""
ORACLES["adapted_name_spans"] = f"""WITH {NAMES}, x AS (SELECT *, coalesce(entity_group, entity) AS raw FROM names)
SELECT doc_id, unit_no, 'PERSON' AS label, word AS text, s AS hit_start, e AS hit_end, 'hf_ner' AS source, score AS confidence, raw AS original_label
FROM x WHERE CASE WHEN raw LIKE 'B-%' OR raw LIKE 'I-%' THEN substr(raw, 3) ELSE raw END IN ('PERSON','PER','PS','인명') AND s IS NOT NULL AND e IS NOT NULL"""
ORACLES["name_detections"] = f"""WITH a AS ({ORACLES['adapted_name_spans']})
SELECT doc_id, unit_no, '성명' AS label, text AS matched, 'S' AS grade, '마스킹' AS action, 'ner' AS source, hit_start, hit_end,
  '개인정보' AS sensitive_type, '성명' AS sensitive_category,
  'NER 모델이 PERSON 개체로 탐지 / original_label=' || original_label || ' / confidence=' ||
  coalesce(printf('%.4f', confidence), '없음') || ' / threshold=0.50' AS reason
FROM a WHERE confidence IS NULL OR confidence >= 0.5"""
_INLINE = f"""{CONTACTS}, {NAMES}, j AS (SELECT n.*, c.text, coalesce(entity_group, entity, '') AS raw, coalesce(score, 0) AS sc FROM names n JOIN contacts c USING (doc_id, unit_no)),
styled AS (
  SELECT 'document' AS style, *, s AS s2, replace(replace(upper(raw), 'B-', ''), 'I-', '') AS ent FROM j WHERE s IS NOT NULL AND e IS NOT NULL AND e - s > 2
  UNION ALL SELECT 'cell', *, coalesce(s, 0), replace(replace(upper(raw), 'B-', ''), 'I-', '') FROM j WHERE coalesce(e, 0) - coalesce(s, 0) > 2
  UNION ALL SELECT 'sheet', *, s, upper(replace(replace(raw, 'B-', ''), 'I-', '')) FROM j WHERE s IS NOT NULL AND e IS NOT NULL)"""
ORACLES["inline_name_detections"] = f"""WITH {_INLINE}
SELECT style, doc_id, unit_no, substr(text, s2 + 1, e - s2) AS matched, s2 AS hit_start, e AS hit_end,
  CASE style WHEN 'cell' THEN 'NER 탐지: PERSON' ELSE CASE style WHEN 'document' THEN 'NER 모델 PERSON 탐지' ELSE 'NER 모델이 PERSON 개체로 탐지' END
    || ' / original_label=' || raw || ' / confidence=' || printf('%.4f', sc) || ' / threshold=0.40' END AS reason
FROM styled WHERE ent IN ('PERSON','PER','PS','인명') AND sc >= 0.4"""

PREDICTIONS = """pr AS (SELECT c_nationkey::BIGINT AS doc_id, c_custkey AS unit_no, (c_custkey * 7) % 101 + 1 AS a, (c_custkey * 13) % 89 + 1 AS b,
  (c_custkey * 29) % 97 + 1 AS c FROM customer),
pq AS (SELECT doc_id, unit_no, b / (a + b + c)::DOUBLE AS p_c, a / (a + b + c)::DOUBLE AS p_s, c / (a + b + c)::DOUBLE AS p_o FROM pr),
preds AS (SELECT *, CASE WHEN p_c = greatest(p_c, p_s, p_o) THEN 'C' WHEN p_s = greatest(p_c, p_s, p_o) THEN 'S' ELSE 'O' END AS grade,
  greatest(p_c, p_s, p_o) AS confidence FROM pq)"""
ORACLES["class_probabilities"] = f"WITH {PREDICTIONS} SELECT * FROM preds"
ORACLES["hold_policy"] = f"""WITH {NOTES}, {PREDICTIONS},
j AS (SELECT p.*, length(trim(CASE WHEN p.unit_no % 10 = 0 THEN ' 짧음 ' ELSE n.text END)) AS n FROM preds p JOIN notes n USING (doc_id, unit_no))
SELECT doc_id, unit_no, CASE WHEN n < 5 OR confidence < 0.5 THEN '판단 보류' ELSE grade END AS pred_grade,
  CASE WHEN n < 5 THEN '입력 문장이 너무 짧음: ' || n || '자' WHEN confidence < 0.5 THEN '모델 확신도 낮음: ' || printf('%.3f', confidence) ELSE '정상 예측' END AS reason,
  CASE WHEN n < 5 THEN 0.0 ELSE confidence END AS confidence, CASE WHEN n >= 5 AND confidence < 0.5 THEN grade END AS suggested_grade FROM j"""
ORACLES["context_detections"] = f"""WITH {PREDICTIONS}
SELECT doc_id, unit_no, grade, 'AI_' || grade AS sensitive_category, 'AI 문장분류 grade=' || grade || ' / confidence=' || printf('%.4f', confidence)
  || ' / threshold=0.45 / C=' || printf('%.4f', p_c) || ' / S=' || printf('%.4f', p_s) || ' / O=' || printf('%.4f', p_o) AS reason
FROM preds WHERE grade <> 'O' AND confidence >= 0.45"""
ORACLES["classifier_gate"] = f"""WITH {LINES}, {NOTES},
g AS (SELECT 'documents' AS source, length(trim(text)) < 10 OR length(regexp_replace(trim(text), '[^a-zA-Z]', '', 'g')) / length(trim(text)) < 0.7 AS skipped FROM lines
  UNION ALL SELECT 'notes', length(trim(text)) < 10 OR length(regexp_replace(trim(text), '[^가-힣]', '', 'g')) / length(trim(text)) < 0.15 FROM notes)
SELECT source, skipped, count(*) AS n FROM g GROUP BY ALL"""
ORACLES["joined_detections"] = f"""WITH RECURSIVE {NOTES},
u AS (SELECT doc_id, unit_no, CASE WHEN unit_no % 4 = 0 THEN '담당 업무 절차와 장비 구성 방식을 정리한 문서' ELSE text END AS text FROM notes),
{hits_cte('u')}, {NAMES}, {PREDICTIONS},
found AS (
  SELECT doc_id, unit_no, 1 AS sr, rid * 100000 + hit_start AS o, 'regex' AS source, label, value AS matched, grade FROM hits
  UNION ALL SELECT u.doc_id, u.unit_no, 2, 0, 'ner', '성명', coalesce(nullif(substr(u.text, s + 1, e - s), ''), word), 'S' FROM names JOIN u USING (doc_id, unit_no)
    WHERE replace(replace(upper(coalesce(entity_group, entity, '')), 'B-', ''), 'I-', '') IN ('PERSON','PER','PS','인명') AND coalesce(score, 0) >= 0.3
      AND s IS NOT NULL AND e - s > 2
  UNION ALL SELECT u.doc_id, u.unit_no, 3, 0, 'ai', '민감정보', '', p.grade FROM preds p JOIN u USING (doc_id, unit_no)
    WHERE p.grade <> 'O' AND p.confidence >= 0.4 AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = u.doc_id AND h.unit_no = u.unit_no)
      AND length(trim(u.text)) >= 10 AND length(regexp_replace(trim(u.text), '[^가-힣]', '', 'g')) / length(trim(u.text)) >= 0.2)
SELECT doc_id, unit_no, row_number() OVER (PARTITION BY doc_id, unit_no ORDER BY sr, o) - 1 AS ord, source, label, matched, grade FROM found"""
ORACLES["scorer_failures"] = f"""WITH RECURSIVE {NOTES},
{hits_cte('notes')}, {NAMES}, {PREDICTIONS},
j AS (SELECT n.doc_id, n.unit_no % 9 = 0 AS ner_bad, p.unit_no IS NOT NULL AS known,
    (p.unit_no IS NULL OR n.unit_no % 8 = 3 OR n.unit_no % 10 = 0)
      AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = n.doc_id AND h.unit_no = n.unit_no)
      AND length(trim(n.text)) >= 10 AND length(regexp_replace(trim(n.text), '[^가-힣]', '', 'g')) / length(trim(n.text)) >= 0.2 AS ai_bad
  FROM notes n LEFT JOIN preds p USING (doc_id, unit_no))
SELECT doc_id, count(*) AS units, count(*) FILTER (ner_bad) AS ner_failed, count(*) FILTER (ai_bad) AS ai_failed FROM j GROUP BY 1"""
ORACLES["detector_output_aliases"] = f"""WITH RECURSIVE {CONTACTS},{hits_cte('contacts')}
SELECT doc_id, unit_no, label, value AS matched, hit_start, hit_end, grade, '마스킹' AS action, label AS sensitive_category,
  '공통 regex_detector 탐지: ' || label AS reason
FROM hits WHERE unit_no % 2 = 0 OR unit_no % 5 > 0"""

# --- plan and redaction -------------------------------------------------------------------------------------------

_DESCS = {
    "rrn": "고유식별정보 — 외부 AI 입력 금지", "passport": "고유식별정보", "ip": "내부 네트워크 정보 — 사이버 공격 악용 위험",
    "phone": "직접 식별 가능한 개인정보", "email": "직접 식별 가능한 개인정보", "empid": "사번 — 개인 식별 가능 정보",
    "account": "계좌번호 — 은행별 패턴 및 하이픈 없는 10~14자리 포함", "freq": "통신 보안 정보 — 도청·혼신 위험",
    "coord": "정밀 위치정보 — 범위로 범주화 권장", "datetime_precise": "정밀 시각 — 보안 공백과 결합 시 범주화 권장",
    "credit_card": "신용·체크카드번호 — 4×4자리 형식", "driver_license": "운전면허번호 — 시도코드-연도-일련번호-검증",
    "vlan_port": "내부 네트워크 구성 정보",
}
_DESC_CASE = "CASE rule " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _DESCS.items()) + " END"
_DET = "STRUCT(ord BIGINT, label VARCHAR, matched VARCHAR, grade VARCHAR, action VARCHAR, source VARCHAR, sr INTEGER, s INTEGER, e INTEGER, reason VARCHAR)"
_G = "CASE {0}.grade WHEN 'C' THEN 3 WHEN 'S' THEN 2 WHEN 'O' THEN 1 ELSE 0 END"


def _better(k: str, x: str) -> str:
    """True when k stays."""
    gk, gx = _G.format(k), _G.format(x)
    return (f"CASE WHEN {k}.sr <> {x}.sr THEN {k}.sr < {x}.sr WHEN {gk} <> {gx} THEN {gk} > {gx} "
            f"WHEN length({k}.matched) <> length({x}.matched) THEN length({k}.matched) > length({x}.matched) ELSE {k}.ord <= {x}.ord END")


def _absorb(k: str, x: str) -> str:
    return (f"struct_pack(ord := {k}.ord, label := {k}.label, matched := {k}.matched, grade := {k}.grade, action := {k}.action, source := {k}.source, "
            f"sr := {k}.sr, s := {k}.s, e := {k}.e, reason := CASE WHEN {k}.reason = '' THEN '' ELSE {k}.reason || ' / ' END || '중복 탐지 흡수: source=' || {x}.source || ', label=' || "
            f"{x}.label || ', matched=' || {x}.matched)")


_AT = "list_position(list_transform(acc, lambda q: q.s < x.e AND x.s < q.e), true)"
_FOLD = (
    f"list_reduce(cands, lambda acc, x: CASE WHEN coalesce({_AT}, 0) = 0 THEN list_append(acc, x) ELSE "
    f"list_transform(acc, lambda k, i: CASE WHEN i = {_AT} THEN CASE WHEN {_better('k', 'x')} THEN {_absorb('k', 'x')} ELSE {_absorb('x', 'k')} END ELSE k END) END, "
    f"[]::{_DET}[])"
)


def _plan(units: str, found: str | None = None) -> str:
    """CTEs ``kept`` (doc_id, unit_no, list of kept targets) and ``targets``; ``found`` replaces the
    pattern hits as input (same columns as in the default)."""
    source = found or f"""SELECT doc_id, unit_no, rid * 100000::BIGINT + hit_start AS ord, label, value AS matched, grade, action, 'regex' AS source,
      1 AS sr, hit_start AS s, hit_end AS e, {_DESC_CASE} AS reason FROM hits"""
    return f"""{hits_cte(units)},
found AS ({source}),
grouped AS (SELECT doc_id, unit_no, list(struct_pack(ord := ord, label := label, matched := matched, grade := grade, action := action,
  source := source, sr := sr, s := s, e := e, reason := reason) ORDER BY ord)::{_DET}[] AS cands FROM found GROUP BY ALL),
kept AS (SELECT doc_id, unit_no, {_FOLD} AS ks FROM grouped),
targets AS (SELECT doc_id, unit_no, t.* FROM (SELECT doc_id, unit_no, unnest(ks) AS t FROM kept))"""


_TARGET_SELECT = """SELECT doc_id, unit_no, label, matched, grade, action, source, s AS hit_start, e AS hit_end, reason FROM targets"""
ORACLES["contact_plan"] = f"WITH RECURSIVE {CONTACTS},{_plan('contacts')} {_TARGET_SELECT}"
ORACLES["contact_plan_from_rows"] = ORACLES["contact_plan"]


def _apply(marker: str) -> str:
    repl = (f"CASE WHEN x.action = '삭제' THEN '{marker}' ELSE repeat('*', x.e - x.s) END")
    return (f"list_reduce(list_reverse_sort(list_transform(ks, lambda k, i: struct_pack(s := k.s, i := -i, e := k.e, action := k.action))), "
            f"lambda acc, x: CASE WHEN x.e > length(acc) THEN acc ELSE substr(acc, 1, x.s) || {repl} || substr(acc, x.e + 1) END, text)")


def _redacted(units: str, marker: str = "") -> str:
    return f"""SELECT u.doc_id, u.unit_no, u.text, CASE WHEN k.ks IS NULL THEN u.text ELSE {_apply(marker)} END AS applied_text
FROM {units} u LEFT JOIN kept k ON k.doc_id = u.doc_id AND k.unit_no = u.unit_no"""


ORACLES["contact_redaction"] = f"""WITH RECURSIVE {CONTACTS},{_plan('contacts')}
SELECT doc_id, unit_no, applied_text FROM ({_redacted('contacts')})"""
ORACLES["streamed_redaction"] = ORACLES["contact_redaction"]
ORACLES["contact_redaction_marked"] = f"""WITH RECURSIVE {CONTACTS},{_plan('contacts')}
SELECT doc_id, unit_no, applied_text FROM ({_redacted('contacts', '(삭제됨)')})"""
ORACLES["document_redaction"] = f"""WITH RECURSIVE {LINES},{_plan('lines')}
SELECT * FROM ({_redacted('lines')}) WHERE text <> applied_text"""
ORACLES["redacted_documents"] = f"""WITH RECURSIVE {LINES},{hits_cte('lines')},
per AS (SELECT l.doc_id, l.unit_no, count(h.rid) AS n, max(coalesce({_GRADE_RANK}, 0)) AS g FROM lines l LEFT JOIN hits h USING (doc_id, unit_no) GROUP BY ALL)
SELECT doc_id, count(*) AS lines, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (n > 0) AS redacted_lines,
  CASE max(g) WHEN 3 THEN 'C' WHEN 2 THEN 'S' ELSE 'O' END AS grade FROM per GROUP BY doc_id"""

_MIXED = f"""SELECT doc_id, unit_no, rid * 100000::BIGINT + hit_start AS ord, label, value AS matched, grade, action, 'regex' AS source, 1 AS sr,
  hit_start AS s, hit_end AS e, '' AS reason FROM hits
UNION ALL SELECT c.doc_id, c.unit_no, 900000000, '성명', coalesce(nullif(substr(c.text, s + 1, e - s), ''), word), 'S', '마스킹', 'ner', 2, s, e, '' FROM names
  JOIN contacts c USING (doc_id, unit_no) WHERE replace(replace(upper(coalesce(entity_group, entity, '')), 'B-', ''), 'I-', '') IN ('PERSON','PER','PS','인명')
  AND coalesce(score, 0) >= 0.3 AND s IS NOT NULL AND e - s > 2"""
_MIXED_PLAN = f"{CONTACTS},{NAMES},{_plan('contacts', _MIXED)}"
ORACLES["mixed_plan"] = f"""WITH RECURSIVE {_MIXED_PLAN}
SELECT 'auto' AS track, source, label, action, count(*) AS n FROM targets GROUP BY ALL"""
ORACLES["plan_source_counts"] = f"""WITH RECURSIVE {_MIXED_PLAN}
SELECT doc_id, (SELECT count(*) FROM contacts c WHERE c.doc_id = f.doc_id) AS units, count(*) FILTER (source = 'regex') AS regex_detections,
  count(*) FILTER (source = 'ner') AS ner_detections, 0::BIGINT AS ai_detections, (SELECT count(*) FROM targets t WHERE t.doc_id = f.doc_id) AS auto_targets,
  0::BIGINT AS review_targets FROM found f GROUP BY doc_id"""
ORACLES["redaction_summary"] = f"""WITH RECURSIVE {_MIXED_PLAN}
SELECT doc_id, count(*) AS total_locations, count(*) AS applied_locations, 0::BIGINT AS partial_locations, 0::BIGINT AS skipped_locations,
  0::BIGINT AS total_warnings, CAST(sum(len(ks)) AS BIGINT) AS auto_target_count, 0::BIGINT AS review_target_count FROM kept GROUP BY doc_id"""
ORACLES["plan_summary_grade"] = f"""WITH RECURSIVE {NOTES},{hits_cte('notes')}
SELECT doc_id, CASE max({_GRADE_RANK}) WHEN 3 THEN 'C' WHEN 2 THEN 'S' WHEN 1 THEN 'O' END AS summary_grade FROM hits GROUP BY doc_id"""

# Notes hold a phone number and for every third customer an address behind it, never overlapping.
_NOTE_HITS = f"{NOTES},{hits_cte('notes')}"
_PER_NOTE = """pn AS (SELECT n.doc_id, n.unit_no, n.text, p.hit_start AS ps, p.hit_end AS pe, p.value AS pv, i.hit_start AS xs, i.hit_end AS xe, i.value AS xv
  FROM notes n JOIN hits p ON p.doc_id = n.doc_id AND p.unit_no = n.unit_no AND p.rule = 'phone'
  LEFT JOIN hits i ON i.doc_id = n.doc_id AND i.unit_no = n.unit_no AND i.rule = 'ip')"""
_NOTE_DONE = """CASE WHEN xs IS NULL THEN substr(text, 1, ps) || repeat('*', pe - ps) || substr(text, pe + 1)
  ELSE substr(text, 1, ps) || repeat('*', pe - ps) || substr(text, pe + 1, xs - pe) || substr(text, xe + 1) END"""
_OVER = "'end가 원문 길이를 초과합니다: end='"
ORACLES["plan_applied_to_contexts"] = f"""WITH RECURSIVE {_NOTE_HITS},{_PER_NOTE}
SELECT doc_id, CAST(unit_no AS INTEGER) AS line_no, text AS original_text, CASE WHEN unit_no % 5 = 0 THEN text ELSE {_NOTE_DONE} END AS applied_text,
  CAST(CASE WHEN unit_no % 5 = 0 THEN 0 WHEN xs IS NULL THEN 1 ELSE 2 END AS INTEGER) AS applied_n,
  CAST(CASE WHEN unit_no % 5 <> 0 THEN 0 WHEN xs IS NULL THEN 1 ELSE 2 END AS INTEGER) AS skipped_n,
  CASE WHEN unit_no % 5 <> 0 THEN '' ELSE CASE WHEN xs IS NULL THEN '' ELSE '내부 IP 주소/' || xv || ': ' || {_OVER} || (xe + 200) || ', text_len=' || length(text) || '#' END
    || '전화번호/' || pv || ': ' || {_OVER} || (pe + 200) || ', text_len=' || length(text) END AS warnings,
  0::INTEGER AS plan_warnings FROM pn"""

# --- cells ----------------------------------------------------------------------------------------------------------

CELLS = """sup AS (SELECT s_suppkey AS k, [s_name, '010-' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') || '-1234 / a' || s_suppkey || '@s.example.org',
    CASE WHEN s_suppkey % 3 = 0 THEN '  ' ELSE '192.168.1.' || (s_suppkey % 250) END] AS cs FROM supplier),
cx AS (SELECT k, unnest([1, 2, 3]) AS col_no, unnest(cs) AS text, unnest(['s_name', 's_contact', 's_host']) AS header FROM sup),
cells AS (SELECT 0::BIGINT AS doc_id, (k + 2) * 1048576 + col_no AS unit_no, CAST(k + 2 AS INTEGER) AS row_no, CAST(col_no AS INTEGER) AS col_no, text, header,
  (k + 2) || '행 ' || header || '열' AS location_label FROM cx WHERE trim(text) <> '')"""
ORACLES["cell_units"] = f"WITH {CELLS} SELECT unit_no, text, location_label, row_no, col_no, header FROM cells"
_CELL_PLAN = f"{CELLS},{_plan('cells')}"
ORACLES["cell_items"] = f"""WITH RECURSIVE {_CELL_PLAN},
names_of AS (SELECT doc_id, unit_no, string_agg(label, ', ' ORDER BY f) AS label FROM (SELECT doc_id, unit_no, label, min(s) AS f FROM targets GROUP BY ALL) GROUP BY ALL),
acts AS (SELECT doc_id, unit_no, string_agg(action, ', ' ORDER BY f) AS action FROM (SELECT doc_id, unit_no, action, min(s) AS f FROM targets GROUP BY ALL) GROUP BY ALL),
r AS ({_redacted('cells', '(삭제됨)')})
SELECT c.location_label, n.label, a.action, c.text AS original_text, r.applied_text, 'applied' AS status, CAST(len(k.ks) AS INTEGER) AS applied_target_count,
  0::INTEGER AS skipped_target_count, CASE WHEN len(list_filter(k.ks, lambda q: q.grade = 'C')) > 0 THEN 'C' ELSE 'S' END AS grade, 'regex' AS source, 0::INTEGER AS warnings
FROM cells c JOIN kept k USING (doc_id, unit_no) JOIN names_of n USING (doc_id, unit_no) JOIN acts a USING (doc_id, unit_no)
JOIN r USING (doc_id, unit_no)"""
ORACLES["cell_summary"] = f"""WITH RECURSIVE {_CELL_PLAN}
SELECT doc_id, count(*) AS total_locations, count(*) AS applied_locations, 0::BIGINT AS partial_locations, 0::BIGINT AS skipped_locations,
  0::BIGINT AS total_warnings, CAST(sum(len(ks)) AS BIGINT) AS auto_target_count, 0::BIGINT AS review_target_count FROM kept GROUP BY doc_id"""

# --- guides ------------------------------------------------------------------------------------------------------------

_SHORT = "CASE WHEN length({0}) <= 30 THEN {0} ELSE substr({0}, 1, 30) || '...' END"
_BASE_LABEL = {
    "docx": "'본문 ' || (unit_no + 1) || '번째 문단'", "pptx": "(unit_no + 1) || '번 슬라이드'",
    "hwpx": "'1번 본문 ' || (unit_no + 1) || '번째 문단'", "pdf": "'1쪽 ' || (unit_no + 1) || '번째 줄'",
}
_LOST = {"docx": "missing_paragraph_no", "pptx": "missing_shape_location", "hwpx": "missing_section_no", "pdf": "missing_page_no"}
_GONE = {"docx": "paragraph_out_of_range", "pptx": "slide_out_of_range", "hwpx": "section_out_of_range", "pdf": "pdf_text_block_not_found"}
_UNKNOWN = {"docx": "unsupported_docx_section", "pptx": "unknown_section", "hwpx": "unknown_section", "pdf": "unknown_section"}


def _guide(t: str) -> str:
    label = f"{_BASE_LABEL[t]} || ': ' || {_SHORT.format('text')}"
    both = "CASE WHEN xs IS NULL THEN {0} ELSE {0} || ', ' || {1} END"
    n = "CASE WHEN xs IS NULL THEN 1 ELSE 2 END"
    return f"""WITH RECURSIVE {_NOTE_HITS},{_PER_NOTE}, w AS (SELECT *, {label} AS location_label, unit_no % 7 AS m FROM pn),
single AS (
  SELECT doc_id, location_label, label, action, text AS original_text, text AS applied_text, 'skipped' AS status, 0::INTEGER AS applied_target_count,
    1::INTEGER AS skipped_target_count, CASE m WHEN 0 THEN '{_LOST[t]}' ELSE '{_UNKNOWN[t]}' END AS codes, NULL::VARCHAR AS grade, NULL::VARCHAR AS source
  FROM (SELECT *, '전화번호' AS label, '마스킹' AS action FROM w UNION ALL SELECT *, '내부 IP 주소', '삭제' FROM w WHERE xs IS NOT NULL) z
  WHERE m IN (0, 2)),
whole AS (
  SELECT doc_id, location_label, {both.format("'전화번호'", "'내부 IP 주소'")} AS label, {both.format("'마스킹'", "'삭제'")} AS action,
    CASE WHEN m = 1 THEN '' ELSE text END AS original_text, CASE WHEN m = 1 THEN '' WHEN m = 3 THEN text ELSE {_NOTE_DONE} END AS applied_text,
    CASE WHEN m IN (1, 3) THEN 'skipped' ELSE 'applied' END AS status, CAST(CASE WHEN m IN (1, 3) THEN 0 ELSE {n} END AS INTEGER) AS applied_target_count,
    CAST(CASE WHEN m IN (1, 3) THEN {n} ELSE 0 END AS INTEGER) AS skipped_target_count,
    CASE m WHEN 1 THEN '{_GONE[t]}' WHEN 3 THEN {both.format("'slice_mismatch'", "'slice_mismatch'").replace(" || ', ' || ", " || ',' || ")} WHEN 4 THEN 'context_mismatch' ELSE '' END AS codes,
    CASE WHEN m = 1 THEN NULL WHEN xs IS NULL THEN 'S' ELSE 'C' END AS grade, CASE WHEN m = 1 THEN NULL ELSE 'regex' END AS source
  FROM w WHERE m NOT IN (0, 2))
SELECT * FROM single UNION ALL SELECT * FROM whole"""


for _t in ("docx", "pptx", "hwpx", "pdf"):
    ORACLES[f"guide_items_{_t}"] = _guide(_t)
# Message texts of lost, unknown and vanished places ({n}: the paragraph, slide or line number).
_LOST_TEXT = {
    "docx": "paragraphNo가 없어 안내를 생성하지 못했습니다.",
    "pptx": "위치 필드(shapeNo/rowNo/colNo 등)가 누락되어 안내를 생성하지 못했습니다.",
    "hwpx": "sectionNo가 없어 안내를 생성하지 못했습니다.",
    "pdf": "pageNo가 없어 안내를 생성하지 못했습니다.",
}
_UNKNOWN_TEXT = {"docx": "section=footer 위치는 현재 docx guide 범위 외이므로 안내를 생성하지 않습니다."} | dict.fromkeys(
    ("pptx", "hwpx", "pdf"), "알 수 없는 section=''footer''이므로 안내를 생성하지 않습니다.")
_GONE_TEXT = {
    "docx": "location=(''body'', {n})가 문서 범위를 벗어났습니다.",
    "pptx": "위치가 현재 pptx에서 발견되지 않습니다 (key=(''shape_text'', {n}, 1, 0)).",
    "hwpx": "위치가 현재 hwpx에서 발견되지 않습니다 (key=(''body'', 0, {n})).",
    "pdf": "위치가 현재 PDF에서 발견되지 않습니다 (key=(''text_line'', 0, {n})).",
}


def _guide_warnings(t: str) -> str:
    label = f"{_BASE_LABEL[t]} || ': ' || {_SHORT.format('text')}"
    what = "line" if t == "pdf" else "paragraph"
    gone = _GONE_TEXT[t].replace("{n}", "' || (unit_no + 10000000) || '")
    return f"""WITH RECURSIVE {_NOTE_HITS},{_PER_NOTE}, w AS (SELECT *, {label} AS location_label, unit_no % 7 AS m FROM pn),
each AS (SELECT *, pv AS v, ps AS s, pe AS e FROM w UNION ALL SELECT *, xv, xs, xe FROM w WHERE xs IS NOT NULL)
SELECT doc_id, location_label, '[{_LOST[t]}] ' || location_label || ': {_LOST_TEXT[t]}' AS warning FROM each WHERE m = 0
UNION ALL SELECT doc_id, location_label, '[{_UNKNOWN[t]}] ' || location_label || ': {_UNKNOWN_TEXT[t]}' FROM each WHERE m = 2
UNION ALL SELECT doc_id, location_label, '[{_GONE[t]}] ' || location_label || ': {gone}' FROM w WHERE m = 1
UNION ALL SELECT doc_id, location_label, '[slice_mismatch] ' || location_label || ': text[start:end]와 matched가 일치하지 않아 자동 적용을 건너뜁니다: actual=''' || v || ''', matched=''' || v
  || 'x'', start=' || s || ', end=' || e FROM each WHERE m = 3
UNION ALL SELECT doc_id, location_label, '[context_mismatch] ' || location_label || ': target.context와 실제 {what} 텍스트가 다릅니다. {what} 텍스트 기준으로 slice 검증 후 권장 여부를 판단합니다.' FROM w WHERE m = 4"""


ORACLES["guide_warnings"] = _guide_warnings("pdf")
for _t in ("docx", "pptx", "hwpx"):
    ORACLES[f"guide_warnings_{_t}"] = _guide_warnings(_t)
ORACLES["guide_summary"] = f"""WITH i AS ({ORACLES['guide_items_docx']})
SELECT doc_id, count(*) AS total_locations, count(*) FILTER (status = 'applied') AS applied_locations, 0::BIGINT AS partial_locations,
  count(*) FILTER (status = 'skipped') AS skipped_locations,
  CAST(sum(CASE WHEN codes = '' THEN 0 WHEN codes LIKE '%,%' THEN 2 WHEN codes IN ('missing_paragraph_no', 'unsupported_docx_section') THEN 2 ELSE 1 END) AS BIGINT) AS total_warnings,
  CAST(sum(applied_target_count + skipped_target_count) AS BIGINT) AS auto_target_count, 0::BIGINT AS review_target_count FROM i GROUP BY doc_id"""

_SHEET_BOTH = "CASE WHEN xs IS NULL THEN {0} ELSE {0} || ', ' || {1} END"
ORACLES["sheet_items"] = f"""WITH RECURSIVE {_NOTE_HITS},{_PER_NOTE},
w AS (SELECT *, '연락처 B' || unit_no AS location_label, unit_no % 8 AS m, unit_no % 16 AS q FROM pn),
single AS (
  SELECT doc_id, location_label, label, action, text AS original_text, text AS applied_text, 'skipped' AS status, 0::INTEGER AS applied_target_count,
    1::INTEGER AS skipped_target_count, CASE WHEN m = 5 THEN 'missing_sheet_name' ELSE 'missing_cell_ref' END AS codes, NULL::VARCHAR AS grade, NULL::VARCHAR AS source
  FROM (SELECT *, '전화번호' AS label, '마스킹' AS action FROM w UNION ALL SELECT *, '내부 IP 주소', '삭제' FROM w WHERE xs IS NOT NULL) z WHERE m = 5 OR q = 7),
whole AS (
  SELECT doc_id, location_label, {_SHEET_BOTH.format("'전화번호'", "'내부 IP 주소'")} AS label, {_SHEET_BOTH.format("'마스킹'", "'삭제'")} AS action,
    CASE WHEN m IN (3, 4) THEN '' ELSE text END AS original_text,
    CASE WHEN m IN (3, 4) THEN '' WHEN m IN (1, 2, 6) THEN text ELSE {_NOTE_DONE} END AS applied_text,
    CASE WHEN m IN (0, 7) THEN 'applied' ELSE 'skipped' END AS status,
    CAST(CASE WHEN m IN (0, 7) THEN CASE WHEN xs IS NULL THEN 1 ELSE 2 END ELSE 0 END AS INTEGER) AS applied_target_count,
    CAST(CASE WHEN m IN (0, 7) THEN 0 ELSE CASE WHEN xs IS NULL THEN 1 ELSE 2 END END AS INTEGER) AS skipped_target_count,
    CASE m WHEN 1 THEN 'formula_cell' WHEN 2 THEN 'non_string_cell' WHEN 3 THEN 'empty_cell' WHEN 4 THEN 'merged_cell_not_top_left' WHEN 6 THEN 'sheet_not_found' ELSE '' END AS codes,
    CASE WHEN m NOT IN (0, 7) THEN NULL WHEN xs IS NULL THEN 'S' ELSE 'C' END AS grade, CASE WHEN m IN (0, 7) THEN 'regex' END AS source
  FROM w WHERE m <> 5 AND q <> 7)
SELECT * FROM single UNION ALL SELECT * FROM whole"""
ORACLES["review_items"] = f"""WITH {PREDICTIONS}, u AS (SELECT *, '업무 담당 부서 ' || (unit_no % 10) || ' 내부 검토 자료' AS text FROM preds)
SELECT doc_id, unit_no, {_BASE_LABEL['pdf']} || ': ' || {_SHORT.format('text')} AS location_label, '민감정보' AS label, '검토 필요' AS action, text AS context,
  grade, 'AI_' || grade AS sensitive_category, 'ai' AS source FROM u WHERE grade <> 'O' AND confidence >= 0.4"""

# --- units -------------------------------------------------------------------------------------------------------------

ORACLES["line_units"] = f"""WITH {LINES}
SELECT doc_id, CAST(unit_no AS INTEGER) AS line_no, text, '1쪽 ' || (unit_no + 1) || '번째 줄: ' ||
  CASE WHEN length(f) <= 30 THEN f ELSE substr(f, 1, 30) || '...' END AS location_label
FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM lines)"""
ORACLES["extraction_stats"] = """
WITH p AS (SELECT conv_id, turn, list_filter(string_split(CASE WHEN turn % 3 = 2 THEN ' ' || chr(10) || ' ' ELSE text END, chr(10)), lambda x: trim(x) <> '') AS ls FROM conversations),
q AS (SELECT conv_id, turn, len(ls) AS n, coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS chars FROM p)
SELECT conv_id AS doc_id, count(*) AS page_count, CAST(sum(n) AS BIGINT) AS total_lines, CAST(sum(chars) AS BIGINT) AS total_chars,
  coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (chars = 0), '') AS empty_pages FROM q GROUP BY conv_id"""

ELEMENTS = """src AS (SELECT conv_id AS doc_id, turn, role, string_split(text, chr(10)) AS ls FROM conversations),
el0 AS (SELECT doc_id, turn, role, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM src),
el AS (SELECT doc_id, turn * 100000 + line_no AS seq, turn, line_no, role = 'user' AS body, CASE WHEN (turn + line_no) % 4 = 3 THEN '  ' ELSE line END AS text,
  CAST(floor(line_no / 2) AS INTEGER) AS row_no FROM el0)"""
_FLAT30 = "CASE WHEN length(f) <= 30 THEN f ELSE substr(f, 1, 30) || '...' END"
_F = "trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f"
ORACLES["paragraph_units"] = f"""WITH {ELEMENTS},
n AS (SELECT *, {_F}, CASE WHEN body THEN row_number() OVER (PARTITION BY doc_id, body ORDER BY seq) ELSE row_number() OVER (PARTITION BY doc_id, body, turn, row_no ORDER BY seq) END - 1 AS p FROM el)
SELECT doc_id, CASE WHEN body THEN seq ELSE seq + 1099511627776 END AS unit_no, CASE WHEN body THEN 'body' ELSE 'table_cell' END AS section, CAST(p AS INTEGER) AS paragraph_no,
  CAST(CASE WHEN NOT body THEN turn END AS INTEGER) AS table_no, CASE WHEN NOT body THEN row_no END AS row_no,
  CASE WHEN body THEN '본문 ' || (p + 1) || '번째 문단' ELSE '표 ' || (turn + 1) || '번 ' || (row_no + 1) || '행 1열' || CASE WHEN p > 0 THEN ' ' || (p + 1) || '번째 문단' ELSE '' END END
    || ': ' || {_FLAT30} AS location_label FROM n WHERE f <> ''"""
ORACLES["section_units"] = f"""WITH {ELEMENTS},
b AS (SELECT *, {_F}, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS p,
  last_value(CASE WHEN trim(text) <> '' THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM el WHERE body),
c AS (SELECT *, {_F}, row_number() OVER (PARTITION BY doc_id, turn, row_no ORDER BY seq) - 1 AS cp FROM el WHERE NOT body),
a AS (SELECT doc_id, seq, 'body' AS section, p, NULL AS cp, NULL AS before, f, NULL AS turn, NULL AS row_no FROM b
  UNION ALL SELECT c.doc_id, c.seq, 'table_cell', b.p, c.cp, b.before, c.f, c.turn, c.row_no FROM c JOIN b ON b.doc_id = c.doc_id AND b.seq = (c.turn - 1) * 100000)
SELECT doc_id, seq AS unit_no, section, CAST(p AS INTEGER) AS paragraph_no, CAST(cp AS INTEGER) AS cell_paragraph_no, before AS preceding_text,
  '1번 본문 ' || (p + 1) || '번째 문단' || CASE WHEN section = 'body' THEN '' ELSE ' 표 ' || (turn + 1) || '번 ' || (row_no + 1) || '행 1열' END || ': ' || {_FLAT30}
  || CASE WHEN before IS NULL THEN '' ELSE ' (앞 문단: ' || CASE WHEN length(before) <= 20 THEN before ELSE substr(before, 1, 20) || '...' END || ')' END AS location_label
FROM a WHERE f <> ''"""
ORACLES["slide_units"] = f"""WITH {ELEMENTS},
k AS (SELECT *, {_F}, CASE WHEN body AND turn % 4 = 2 THEN 'notes' WHEN body THEN 'shape_text' ELSE 'table_cell' END AS kind, turn % 3 AS depth FROM el WHERE turn % 3 <= 1),
n AS (SELECT *, sum(CASE WHEN kind = 'table_cell' AND line_no = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS ti,
  row_number() OVER (PARTITION BY doc_id, kind, depth, turn, CASE WHEN kind = 'table_cell' THEN row_no END ORDER BY seq) - 1 AS p FROM k)
SELECT doc_id, CASE WHEN kind = 'notes' THEN seq + 2199023255552 ELSE seq END AS unit_no, CASE WHEN depth = 1 THEN 'group_' ELSE '' END || kind AS section, CAST(p AS INTEGER) AS paragraph_no,
  CAST(CASE WHEN kind = 'table_cell' THEN ti END AS INTEGER) AS table_index, CAST(CASE WHEN kind <> 'notes' THEN turn END AS INTEGER) AS shape_no,
  '1번 슬라이드' || CASE WHEN kind = 'notes' AND depth = 1 THEN ' (group_notes)' WHEN kind = 'notes' THEN ' 발표자 노트' ELSE CASE WHEN depth = 1 THEN ' (그룹 내부)' ELSE '' END END
  || CASE WHEN kind = 'table_cell' THEN ' 표 ' || (ti + 1) || '번 ' || (row_no + 1) || '행 1열' ELSE '' END || ': ' || {_FLAT30} AS location_label FROM n WHERE f <> ''"""
ORACLES["location_keys"] = f"""WITH {NOTES}
SELECT doc_id, unit_no, CASE unit_no % 4 WHEN 0 THEN '{{"fileType":"csv","rowNo":' || unit_no || ',"colNo":2}}' WHEN 1 THEN 'label:라벨 ' || (unit_no % 50)
  WHEN 2 THEN 'context:' || text ELSE 'order:' || unit_no END AS loc_key FROM notes"""

MARKDOWN = """md0 AS (SELECT doc_id, 'manual ' || doc_id || '.v1.md' AS source_file, string_split(text, chr(10)) AS ls FROM documents),
md1 AS (SELECT doc_id, source_file, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM md0),
md AS (SELECT doc_id, source_file, i, CASE i % 11 WHEN 0 THEN '## ' || substr(x, 1, 20) WHEN 3 THEN '### ' || substr(x, 1, 15)
  WHEN 5 THEN '**' || replace(substr(x, 1, 12), '*', '') || '** :' WHEN 7 THEN '<!-- page ' || i || ' -->'
  WHEN 8 THEN '| ' || substr(x, 1, 10) || ' | ' || substr(x, 11, 10) || ' |' WHEN 9 THEN '|---|:-:|' ELSE x END AS line FROM md1)"""


def _headed(lines: str, key: str) -> str:
    """CTEs that classify Markdown lines and carry the headings; ``lines`` has (key, i, line)."""
    return f"""cl AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)<!--\\s*page\\s+\\d+\\s*-->') THEN 'page' WHEN regexp_matches(line, '^##\\s+.+$') THEN 'h2'
    WHEN regexp_matches(line, '^###\\s+.+$') THEN 'h3' WHEN regexp_matches(line, '^\\*\\*[^*]+\\*\\*\\s*[：:]?\\s*$') THEN 'bold'
    WHEN trim(line) LIKE '|%|' AND length(regexp_replace(line, '[^|]', '', 'g')) >= 2 THEN CASE WHEN regexp_matches(line, '^\\s*\\|?\\s*:?-{{3,}}:?\\s*(\\|\\s*:?-{{3,}}:?\\s*)+\\|?\\s*$') THEN 'rule' ELSE 'row' END
    WHEN trim(line) = '' THEN 'blank' ELSE 'text' END AS kind FROM {lines}),
t2 AS (SELECT *, CASE WHEN kind = 'h2' THEN trim(regexp_extract(line, '^##\\s+(.+)$', 1)) END AS h2v, CASE WHEN kind = 'h3' THEN trim(regexp_extract(line, '^###\\s+(.+)$', 1)) END AS h3v,
    CASE WHEN kind = 'bold' THEN trim(regexp_extract(line, '^\\*\\*([^*]+)\\*\\*', 1)) END AS bv,
    sum(CASE WHEN kind = 'h2' THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i) AS g2, sum(CASE WHEN kind IN ('h2', 'h3') THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i) AS g3,
    sum(CASE WHEN kind NOT IN ('text', 'row', 'rule', 'blank') THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY i) AS gb FROM cl),
t3 AS (SELECT *, coalesce(last_value(h2v IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY i), '') AS a2,
    coalesce(last_value(h3v IGNORE NULLS) OVER (PARTITION BY {key}, g2 ORDER BY i), '') AS a3, coalesce(last_value(bv IGNORE NULLS) OVER (PARTITION BY {key}, g3 ORDER BY i), '') AS a4 FROM t2),
t4 AS (SELECT *, array_to_string(list_filter([a2, a3, a4], lambda p: p <> ''), ' > ') AS heading_path FROM t3)"""


_ROW_TEXT = "array_to_string(list_filter(list_transform(string_split(trim(trim(line), '|'), '|'), lambda c: trim(c)), lambda c: c <> ''), ' / ')"
_HEADER_TERMS = ("구분", "항목", "내용", "비고", "설비명", "점검항목", "검사항목", "확인사항", "점검주기", "검사주기", "측정값", "판정기준")


_CLASS = r"[\\s|/·•ㆍ\-_:：,.;()\[\]]+"
_CK = "regexp_replace({0}, '" + _CLASS + "', '', 'g')"


def _is_header(x: str) -> str:
    k = _CK.format(x)
    return f"(length({k}) <= 80 AND " + " + ".join(f"contains({k}, '{t}')::INT" for t in _HEADER_TERMS) + " >= 2)"


def _md_units(lines: str, key: str) -> str:
    return f"""{_headed(lines, key)},
u0 AS (SELECT {key}, i, heading_path, CASE WHEN kind = 'row' THEN {_ROW_TEXT} ELSE trim(line) END AS text, kind FROM t4 WHERE kind IN ('row', 'text')),
u AS (SELECT {key}, heading_path, text, CAST(row_number() OVER w - 1 AS INTEGER) AS unit_no, coalesce(substr(lag(text) OVER w, 1, 400), '') AS preceding_text
  FROM u0 WHERE text <> '' AND NOT (kind = 'row' AND {_is_header('text')}) WINDOW w AS (PARTITION BY {key} ORDER BY i))"""


_UNIT_ID = ("replace(substr(regexp_replace(source_file, '\\.[^.]*$', ''), 1, 20), ' ', '_') || '_' || "
            "substr(sha256(source_file || '|' || heading_path || '|' || text), 1, 10)")
ORACLES["markdown_units"] = f"WITH {MARKDOWN},{_md_units('md', 'source_file')} SELECT *, {_UNIT_ID} AS unit_id FROM u"


ORACLES["markdown_line_units"] = f"WITH {MARKDOWN},{_md_units('md', 'source_file')} SELECT * FROM u"


def _md_blocks(lines: str, key: str) -> str:
    return f"""{_headed(lines, key)},
b0 AS (SELECT {key}, gb, min(i) AS i, min(heading_path) AS heading_path, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(10)) AS text FROM t4
  WHERE kind IN ('text', 'row', 'rule', 'blank') GROUP BY ALL),
b AS (SELECT {key}, heading_path, text, CAST(row_number() OVER w - 1 AS INTEGER) AS unit_no, coalesce(substr(lag(text) OVER w, 1, 400), '') AS preceding_text
  FROM b0 WHERE text <> '' WINDOW w AS (PARTITION BY {key} ORDER BY i))"""


ORACLES["markdown_blocks"] = f"WITH {MARKDOWN},{_md_blocks('md', 'source_file')} SELECT * FROM b"

# --- mining ---------------------------------------------------------------------------------------------------------------

_OPEN = r"목\s*차|차\s*례|개정\s*이력|제\s*개정\s*이력|문서\s*목적|적용\s*범위|용어\s*설명|용어의\s*정의|머리말|꼬리말|표\s*지"
_RULE = r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"
_TITLE = r"^[#\s\-*]*(?:[\p{L}\p{N}_]+\s*){1,6}(?:매뉴얼|목록|현황|표준)[#\s\-*]*$"
_STARTS = ("설비명", "검사항목", "점검주기", "관련기준", "검사방법", "참고사항", "점검항목", "확인사항", "판정기준", "검사주기")


def _schedule(k: str) -> str:
    return (f"((contains({k}, '설비명') AND regexp_matches({k}, '(점검|검사)?주기|반기|분기|월간|연간|[0-9]+일|[0-9]+년')) OR (length({k}) <= 80 AND "
            f"regexp_matches({k}, '설비명|점검주기|검사주기|점검항목|검사항목') AND NOT regexp_matches({k}, '(?i)수동|강제|절체|우회|BYPASS|비상|해제|명령|Script|설정')) OR "
            f"regexp_matches({k}, '^(확인)?해당역사예비품교체$'))")


def _noise_case(text: str, heading: str, current: bool = True) -> str:
    s, k = f"trim({text})", _CK.format(f"trim({text})")
    early = f"regexp_replace({s}, '[|\\s]', '', 'g')"
    if current:
        return f"""CASE WHEN {s} = '' THEN 'blank' WHEN length(regexp_replace({s}, '\\s+', '', 'g')) < 15 THEN 'too_short'
  WHEN (length({s}) - length(replace({s}, ' ', ''))) / length({s}) > 0.30 THEN 'scattered' WHEN {' OR '.join(f"starts_with({s}, '{x}')" for x in _STARTS)} THEN 'label_row'
  WHEN regexp_matches({s}, '(?i)^\\s*<!--\\s*page\\s+\\d+\\s*-->\\s*$') THEN 'page_comment' WHEN regexp_matches({s}, '{_RULE}') THEN 'table_rule'
  WHEN contains({s}, '| ---') OR regexp_matches({s}, '(\\|[^|]{{0,20}}){{3,}}') THEN 'table_fragment'
  WHEN regexp_matches({k}, '(?i)Ver\\.?\\s*\\d|개정일|개정이력|목차|차례') OR regexp_matches({s}, '[.·]{{3,}}\\s*\\d+\\s*$') THEN 'contents_or_revision'
  WHEN {_schedule(k)} THEN 'schedule' WHEN regexp_matches({heading} || ' ' || {s}, '{_OPEN}') THEN 'open_content' WHEN {_is_header(s)} THEN 'table_header'
  WHEN length({s}) <= 40 AND regexp_matches({s}, '{_TITLE}') THEN 'title_only' END"""
    terms = " + ".join(f"contains({early}, '{t}')::INT" for t in _HEADER_TERMS[:8])
    return f"""CASE WHEN {s} = '' OR regexp_matches({s}, '(?i)^\\s*<!--\\s*page\\s+\\d+\\s*-->\\s*$') OR regexp_matches({s}, '{_RULE}') OR regexp_matches({s}, '개정\\s*일\\s*[:：]')
  OR regexp_matches({heading} || ' ' || {s}, '{_OPEN}') OR (length({early}) <= 60 AND {terms} >= 2) OR (length({s}) <= 40 AND regexp_matches({s}, '{_TITLE}')) THEN 'noise' END"""


MANUALS = f"ml AS (SELECT 'manual ' || p_size || '.md' AS source_file, p_partkey AS line_no, {D.MANUAL_LINE} AS line FROM part)"
ORACLES["noise_rules"] = f"""WITH {MANUALS}
SELECT line_no, {_noise_case('line', 'source_file')} AS reason, {_noise_case('line', 'source_file', False)} IS NOT NULL AS noise_before, {_schedule(_CK.format('line'))} AS schedule,
  {_CK.format('line')} AS compacted, trim(line) LIKE '|%|' AND length(regexp_replace(line, '[^|]', '', 'g')) >= 2 AS table_row FROM ml"""
ORACLES["document_noise"] = f"""WITH {LINES} SELECT coalesce({_noise_case('text', "''")}, 'kept') AS reason, count(*) AS n FROM lines GROUP BY 1"""

_ROLES = {
    "strong_procedural": ("C", ["복구 절차", "카드 리셋", "원격 투입", "차단기 원격 투입", "전원 투입 순서"]),
    "ambiguous_action": ("ambiguous", ["장애", "복구", "점검", "투입"]), "operational_anchor": ("anchor", ["장비", "회선", "서버", "차단기"]),
    "s_business_sensitive": ("S", ["계약 금액", "단가", "내부 보고"]), "weak": ("weak", ["확인", "상태", "정상", "표시", "기준"]),
}
_NORM = "lower(regexp_replace({0}, '\\s+', '', 'g'))"


def _role(role: str, text: str) -> str:
    """Matched keywords, longest first."""
    kws = sorted(_ROLES[role][1], key=lambda k: -len(k.replace(" ", "")))
    return "list_filter([" + ", ".join(f"'{k}'" for k in kws) + f"], lambda q: contains({_NORM.format(text)}, replace(q, ' ', '')))"


ORACLES["keyword_matches"] = f"WITH {MANUALS} " + " UNION ALL ".join(
    f"SELECT line_no, unnest({_role(r, 'line')}) AS kw, '{t}' AS track, '{r}' AS role FROM ml" for r, (t, _) in _ROLES.items())

_FILES = f"""mf AS (SELECT 'manual ' || CAST(floor(p_partkey / 40) AS BIGINT) || '.md' AS source_file, p_partkey AS i, {D.MANUAL_LINE} AS line FROM part)"""


def _mined(current: bool = True) -> str:
    """CTE ``dec``: decisions per kept unit."""
    return f"""{_FILES},{_md_units('mf', 'source_file')},
nz AS (SELECT *, {_noise_case('text', 'heading_path', current)} AS reason FROM u),
keyed AS (SELECT row_number() OVER (ORDER BY source_file, unit_no) AS doc_id, unit_no::BIGINT AS unit_no, * EXCLUDE (unit_no) FROM nz WHERE reason IS NULL),
{_identified('keyed')},
ids AS (SELECT doc_id, count(*) AS n, string_agg('regex_identifier:' || value, '|' ORDER BY rid, hit_start) AS r FROM identified GROUP BY doc_id),
m AS (SELECT k.*, {_role('strong_procedural', 'text')} AS st, {_role('s_business_sensitive', 'text')} AS sb, {_role('ambiguous_action', 'text')} AS am,
  {_role('operational_anchor', 'text')} AS an, {_role('weak', 'text')} AS wk, coalesce(ids.n, 0) AS rx, ids.r FROM keyed k LEFT JOIN ids USING (doc_id)),
m2 AS (SELECT *, len(am) > 0 AND len(an) > 0 AS pair, len(st) > 0 OR len(sb) > 0 {'' if current else 'OR (len(am) > 0 AND len(an) > 0)'} AS ctx FROM m),
dec AS (SELECT *, round(3.0 * len(st) + 2.0 * len(sb) + CASE WHEN pair THEN 2.0 * least(len(am), len(an)) ELSE 0 END + CASE WHEN ctx THEN 0.2 * least(len(wk), 3) ELSE 0 END, 2)::DOUBLE AS score,
  '[' || concat_ws(',', CASE WHEN ctx THEN '"ai_procedural_sensitive"' END, CASE WHEN rx > 0 THEN '"regex_identifier"' END) || ']' AS kinds,
  CASE WHEN len(st) > 0 OR pair THEN 'C' WHEN len(sb) > 0 THEN 'S' ELSE '' END AS hint FROM m2 WHERE ctx OR rx > 0)"""


def _tagged(col: str, role: str) -> str:
    return f"list_transform({col}, lambda q: '{role}:' || q)"


_BAND = "CASE WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END"
ORACLES["mined_candidates"] = f"""WITH RECURSIVE {_mined()}
SELECT source_file AS "sourceFile", {_UNIT_ID} AS "unitId", text, heading_path AS "headingPath", preceding_text AS "precedingText", kinds AS "candidateType",
  CASE WHEN rx > 0 AND NOT ctx THEN 'true' ELSE 'false' END AS "regexOnly", CASE WHEN score >= 3 THEN hint ELSE '' END AS "suggestedGrade", score AS "priorityScore", {_BAND} AS "priorityBand",
  CAST(len(st) + len(sb) AS INTEGER) AS "strongKeywordCount", CAST(len(am) AS INTEGER) AS "ambiguousActionCount", CAST(len(an) AS INTEGER) AS "anchorKeywordCount",
  CAST(len(wk) AS INTEGER) AS "weakKeywordCount", CAST(rx AS INTEGER) AS "regexIdentifierCount", 'false' AS "noiseFlag", '' AS "userGrade", '' AS memo,
  array_to_string(list_concat({_tagged('st', 'strong_procedural')}, {_tagged('sb', 's_business_sensitive')}, CASE WHEN pair THEN list_concat({_tagged('am', 'ambiguous_action')},
    {_tagged('an', 'operational_anchor')}) ELSE [] END, CASE WHEN ctx THEN {_tagged('wk', 'weak')} ELSE [] END, CASE WHEN r IS NULL THEN [] ELSE [r] END), '|') AS reasons FROM dec"""
ORACLES["mined_candidates_second_policy"] = f"""WITH RECURSIVE {_mined(False)}
SELECT source_file AS "sourceFile", {_UNIT_ID} AS "unitId", text, kinds AS "candidateType", CASE WHEN rx > 0 AND NOT ctx THEN 'true' ELSE 'false' END AS "regexOnly", hint AS "suggestedGrade",
  score AS "priorityScore" FROM dec"""
ORACLES["mined_candidates_second_policy"] = ORACLES["mined_candidates_second_policy"].replace(
    f"AND NOT (kind = 'row' AND {_is_header('text')})",
    "AND NOT (kind = 'row' AND length(regexp_replace(text, '[|\\s]', '', 'g')) <= 60 AND " + " + ".join(
        f"contains(regexp_replace(text, '[|\\s]', '', 'g'), '{t}')::INT" for t in _HEADER_TERMS[:8]) + " >= 2)")
ORACLES["mined_candidates_first_policy"] = f"""WITH RECURSIVE {_FILES},{_md_blocks('mf', 'source_file')},
keyed AS (SELECT row_number() OVER (ORDER BY source_file, unit_no) AS doc_id, unit_no::BIGINT AS unit_no, * EXCLUDE (unit_no) FROM b),
{hits_cte('keyed', BASE + EXTRA[:4])}, ids AS (SELECT DISTINCT doc_id, 1 AS n FROM hits),
m AS (SELECT k.*, ids.n IS NOT NULL AS rx, len(list_filter(['복구절차', '카드리셋', '원격투입', '단가', '계약금액'], lambda q: contains({_NORM.format('text')}, q))) > 0 AS st,
  len({_role('weak', 'text')}) > 0 AS wk FROM keyed k LEFT JOIN ids USING (doc_id))
SELECT source_file AS "sourceFile", {_UNIT_ID} AS "unitId", '[' || concat_ws(',', CASE WHEN st THEN '"ai_procedural_sensitive"' END, CASE WHEN rx THEN '"regex_identifier"' END) || ']' AS "candidateType",
  CASE WHEN rx AND NOT st AND NOT wk THEN 'true' ELSE 'false' END AS "regexOnly", CAST(length(text) AS INTEGER) AS chars FROM m WHERE st OR rx"""
ORACLES["mining_counts"] = f"""WITH RECURSIVE {_mined()},
f AS (SELECT source_file, count(*) AS units, count(reason) AS noise FROM nz GROUP BY 1),
g AS (SELECT source_file, count(*) FILTER (ctx) AS ai, count(*) FILTER (rx > 0) AS regex, count(*) FILTER (rx > 0 AND NOT ctx) AS ro FROM dec GROUP BY 1)
SELECT f.source_file AS "sourceFile", CAST(sum(units) AS BIGINT) AS units, CAST(sum(noise) AS BIGINT) AS noise, CAST(sum(coalesce(ai, 0)) AS BIGINT) AS ai,
  CAST(sum(coalesce(regex, 0)) AS BIGINT) AS regex, CAST(sum(coalesce(ro, 0)) AS BIGINT) AS "regexOnly" FROM f LEFT JOIN g USING (source_file) GROUP BY ROLLUP (f.source_file)"""
ORACLES["mining_cutoff"] = f"""WITH RECURSIVE {_mined()}
SELECT min(score) AS min_priority, count(*) AS rows FROM (SELECT score FROM dec WHERE ctx ORDER BY score DESC LIMIT 100)"""
ORACLES["mining_review_order"] = f"""WITH RECURSIVE {_mined()}
SELECT source_file AS "sourceFile", CAST(unit_no AS INTEGER) AS unit_no, score AS "priorityScore", CAST(len(st) + len(sb) AS INTEGER) AS "strongKeywordCount", {_BAND} AS "priorityBand",
  row_number() OVER (ORDER BY score DESC, len(st) + len(sb) DESC, source_file, unit_no) AS "reviewRank" FROM dec"""

# --- curation -------------------------------------------------------------------------------------------------------------

DIRTY = """dirty AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN ' #REF! ' WHEN doc_id % 50 = 1 THEN NULL ELSE
  '① A/S ( 점검 ) / 목록 ◆ ( ) 값 1/2 /끝 .' || replace(replace(text, '. ', ' / '), ', ', ' ( ') END AS text FROM documents)"""
_BULLETS = "[①-⓿\\x{f000}-\\x{f0ff}◯○●◦▪▫■□◆◇★☆※·∙•‣⁃◈◐◑]"
# Slashes: those between letters or digits are parked on a private character while the others go.
_PARKED = "regexp_replace(regexp_replace(b, '([A-Za-z0-9가-힣])/([A-Za-z0-9가-힣])', '\\1\\x{e000}\\2', 'g'), '([A-Za-z0-9가-힣])/([A-Za-z0-9가-힣])', '\\1\\x{e000}\\2', 'g')"
CLEANED = f"""{DIRTY},
c1 AS (SELECT doc_id, text, regexp_replace(nfc_normalize(text), '{_BULLETS}', ' ', 'g') AS b FROM dirty),
c2 AS (SELECT doc_id, text, replace(replace({_PARKED.replace(chr(92) + 'x{e000}', chr(0xe000))}, '/', ' '), chr(57344), '/') AS b FROM c1),
c3 AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '[\\r\\n\\t]', ' ', 'g'), '\\(\\s+', '(', 'g'), '\\s+\\)', ')', 'g'), '\\(\\s*\\)', '', 'g') AS b FROM c2),
cleaned AS (SELECT doc_id, text AS raw, CASE WHEN text IS NULL THEN '' WHEN trim(text) IN ('#NAME?', '#REF!', '#VALUE!', '#DIV/0!', '#N/A') THEN '[CORRUPTED_EXCEL_FORMULA]'
  ELSE regexp_replace(trim(regexp_replace(b, '\\s+', ' ', 'g')), '\\s+([.,)])', '\\1', 'g') END AS text FROM c3)"""
ORACLES["clean_text"] = f"WITH {CLEANED} SELECT doc_id, text FROM cleaned"
ORACLES["cleaning_counts"] = f"""WITH {CLEANED} SELECT count(*) AS rows, count(*) FILTER (text IS DISTINCT FROM raw) AS changed,
  count(*) FILTER (text = '[CORRUPTED_EXCEL_FORMULA]') AS corrupted FROM cleaned"""
ORACLES["document_profile"] = f"""WITH {DIRTY} SELECT 'doc_id' AS "column", count(*) FILTER (doc_id IS NULL) AS nulls FROM dirty
UNION ALL SELECT 'text', count(*) FILTER (text IS NULL) FROM dirty"""
ORACLES["text_lengths"] = "SELECT doc_id, CAST(length(text) AS INTEGER) AS text_length FROM documents"

LABELLED = "lab AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in D.LABELLED_COLUMNS.items()) + " FROM labels l JOIN documents d USING (doc_id))"
_FLAGS = ("has_personal", "has_sensitive_legal", "has_sensitive_business", "is_direct_sensitive_text", "is_document_sensitive_signal")
_ISSUES = [(f"{f} NOT IN ('Y', 'N')", "R1", f"'{f} 값은 Y 또는 N이어야 합니다: ' || {f}") for f in _FLAGS] + [
    ("cso_grade NOT IN ('C', 'S', 'O')", "R2", "'cso_grade 값은 C/S/O 중 하나여야 합니다: ' || cso_grade"),
    ("is_direct_sensitive_text = 'Y' AND deidentify_method = '해당 없음'", "R3", "'is_direct_sensitive_text=Y이면 deidentify_method는 ''해당 없음''이면 안 됩니다.'"),
    ("is_direct_sensitive_text = 'N' AND deidentify_method <> '해당 없음'", "R4", "'is_direct_sensitive_text=N이면 deidentify_method는 ''해당 없음''이어야 합니다.'"),
    ("is_document_sensitive_signal = 'Y' AND indicated_sensitive_category = '해당 없음'", "R5",
     "'is_document_sensitive_signal=Y이면 indicated_sensitive_category가 구체적으로 부여되어야 합니다.'"),
    ("is_document_sensitive_signal = 'N' AND indicated_sensitive_category <> '해당 없음'", "R6",
     "'is_document_sensitive_signal=N이면 indicated_sensitive_category는 ''해당 없음''이어야 합니다.'"),
    ("(has_personal = 'Y' OR has_sensitive_legal = 'Y' OR has_sensitive_business = 'Y') AND cso_grade = 'O'", "R7",
     "'has_* 플래그 중 하나라도 Y이면 cso_grade는 O이면 안 됩니다.'"),
    ("cso_grade = 'O' AND is_direct_sensitive_text = 'Y'", "R8", "'cso_grade=O이면 is_direct_sensitive_text는 N이어야 합니다.'"),
    ("has_personal = 'Y' AND has_sensitive_legal = 'N' AND has_sensitive_business = 'N' AND sensitive_category NOT IN ('성명', '연락처', '이메일', '사번', '성명/연락처')", "R9",
     "'has_personal=Y 단독 문장은 sensitive_category가 개인정보 계열이어야 합니다.'"),
]
ORACLES["label_issues"] = f"WITH {LABELLED} " + " UNION ALL ".join(
    f"SELECT id, '{r}' AS rule, {m} AS message, text FROM lab WHERE {c}" for c, r, m in _ISSUES)
ORACLES["label_value_counts"] = f"WITH {LABELLED} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM lab GROUP BY {c}""" for c in (*_FLAGS, "cso_grade"))
ORACLES["top_categories"] = f"WITH {LABELLED} SELECT sensitive_category, count(*) AS n FROM lab GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20"

_WORDS = ("내부망", "서버 IP", "서버IP", "방화벽 정책", "방화벽", "취약점", "접근 권한", "접근권한", "계정", "비밀번호", "인증", "침해 탐지", "침해탐지")
_SENSITIVE = ("계약정보", "예산/원가정보", "계획/전략정보", "감사/법무정보", "입찰평가", "입찰정보", "인사정보", "인사/조직정보", "운영/유지보수정보",
              "장애/사고대응", "운용데이터", "단속/민원정보", "민원처리정보", "보안운영정보")
REGRADED = f"""{LABELLED}, rw AS (SELECT *, list_filter([{', '.join(f"'{w}'" for w in _WORDS)}], lambda q: contains(text, q)) AS ws FROM lab),
rg AS (SELECT *, cso_grade AS original_grade, CASE
  WHEN sensitive_category IN ('일반업무', '분류설명') THEN ['O', 'O유지: 카테고리=' || sensitive_category]
  WHEN has_sensitive_legal <> 'Y' AND has_personal <> 'Y' AND has_sensitive_business <> 'Y' THEN ['O', 'O자동: 민감 플래그 모두 N']
  WHEN has_sensitive_legal = 'Y' THEN ['C', 'C유지: has_sensitive_legal=Y (cat=' || sensitive_category || ')']
  WHEN sensitive_category IN ('건강정보', '복지정보') THEN ['C', 'C유지: 법령상 민감정보 (cat=' || sensitive_category || ')']
  WHEN sensitive_category = '보안정보' AND len(ws) > 0 THEN ['C', 'C유지: 보안정보+키워드(' || array_to_string(ws[1:3], ', ') || ')']
  WHEN sensitive_category = '보안정보' THEN ['S', 'S재분류: 보안정보(공격악용키워드없음)']
  WHEN sensitive_category IN ({', '.join(f"'{c}'" for c in _SENSITIVE)}) THEN ['S', 'S재분류: ' || sensitive_category || CASE WHEN cso_grade <> 'S' THEN '(기존=' || cso_grade || ')' ELSE '' END]
  ELSE [cso_grade, '원본유지: (cat=' || sensitive_category || ')'] END AS res FROM rw),
regraded AS (SELECT *, res[1] AS label, res[2] AS remap_reason FROM rg)"""
ORACLES["regraded_labels"] = f"WITH {REGRADED} SELECT id, original_grade, label, remap_reason FROM regraded"
FEEDBACK = ("fb AS (SELECT *, \"userGrade\" IS NOT DISTINCT FROM \"aiGrade\" AS agree, \"userGrade\" = 'X' AS fp FROM (SELECT l.doc_id, "
            + ", ".join(f'{e} AS "{n}"' for n, e in D.FEEDBACK_COLUMNS.items()) + " FROM labels l JOIN documents d USING (doc_id)) z)")
ORACLES["merged_training_set"] = f"""WITH {REGRADED},{FEEDBACK}
SELECT text, label, '0' AS augmented, 'privacy_v5' AS source, 'privacy_sentence_sample_v5.csv' AS "sourceFile", original_grade AS "originalGrade", has_personal AS "hasPersonal",
  has_sensitive_legal AS "hasSensitiveLegal", has_sensitive_business AS "hasSensitiveBusiness", sensitive_category AS "sensitiveCategory", remap_reason AS "remapReason", note AS memo FROM regraded
UNION ALL SELECT context, "userGrade", CASE WHEN doc_id % 3 = 0 THEN '1' ELSE '0' END, 'trainset', coalesce("fileType", ''), "userGrade", '', '', '', '', 'trainset_label', ''
FROM fb WHERE "userGrade" IN ('C', 'S', 'O')"""
ORACLES["regrade_audit"] = f"""WITH {REGRADED} SELECT original_grade, label, count(*) AS n, original_grade <> label AS changed,
  round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1)::DOUBLE AS share FROM regraded GROUP BY original_grade, label"""
ORACLES["changed_rows"] = f"""WITH {REGRADED} SELECT id, original_grade, label FROM regraded WHERE original_grade <> label ORDER BY id LIMIT 20"""
ORACLES["appended_rows"] = f"""WITH {LABELLED},{FEEDBACK} SELECT id, text, cso_grade FROM lab
UNION ALL SELECT CAST((SELECT max(id::BIGINT) FROM lab) + row_number() OVER (ORDER BY doc_id) AS VARCHAR), context, 'O' FROM fb"""
ORACLES["failed_expectations"] = f"""WITH {REGRADED}, want(text, expected) AS (VALUES ('en src1', 'C'), ('fr src2', 'O'), ('없는 문장', 'S')),
have AS (SELECT text, arg_max(label, id) AS actual FROM regraded GROUP BY text)
SELECT want.text, expected, actual FROM want LEFT JOIN have USING (text) WHERE expected IS DISTINCT FROM actual"""

# --- models and evaluation ------------------------------------------------------------------------------------------------------

ORACLES["char_ngram_counts"] = """
WITH w AS (SELECT item_id, ' ' || unnest(list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) || ' ' AS p FROM benchmark),
g AS (SELECT item_id, p, unnest([2, 3, 4]) AS n FROM w),
t AS (SELECT item_id, unnest(list_transform(range(1, greatest(length(p) - n + 1, 1) + 1), lambda i: substr(p, i, n))) AS term FROM g WHERE n = 2 OR length(p) >= n)
SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL"""
ORACLES["whole_text_ngram_counts"] = """
WITH w AS (SELECT item_id, regexp_replace(lower(text), '\\s\\s+', ' ', 'g') AS p FROM benchmark), g AS (SELECT item_id, p, unnest([2, 3, 4, 5]) AS n FROM w),
t AS (SELECT item_id, unnest(list_transform(range(1, length(p) - n + 2), lambda i: substr(p, i, n))) AS term FROM g WHERE length(p) >= n)
SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL"""


def _words(source: str, key: str) -> str:
    return f"""w AS (SELECT {key} AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_][\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS ws FROM {source}),
t AS (SELECT id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w),
tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL)"""


ORACLES["word_ngram_counts"] = f"WITH {_words('conversations', 'conv_id * 1000 + turn')} SELECT * FROM tf"
ORACLES["word_tfidf"] = f"""WITH {_words('documents', 'doc_id')}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
raw AS (SELECT id, term, tf, tf * (ln((1.0 + n.n) / (1.0 + df)) + 1.0) AS r FROM tf JOIN df USING (term), n), norm AS (SELECT id, sqrt(sum(r * r)) AS z FROM raw GROUP BY id)
SELECT id AS doc_id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS tokens, round(sum(r / z), 6) AS weight_sum, round(max(r / z), 6) AS weight_max FROM raw JOIN norm USING (id) GROUP BY id"""
ORACLES["char_tfidf"] = f"""WITH tf AS ({ORACLES['char_ngram_counts']}), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM benchmark),
raw AS (SELECT item_id, term, tf, df, tf * (ln((1.0 + n.n) / (1.0 + df)) + 1.0) AS r FROM tf JOIN df USING (term), n), norm AS (SELECT item_id, sqrt(sum(r * r)) AS z FROM raw GROUP BY item_id)
SELECT item_id, term, tf, df, round(r / z, 6) AS weight FROM raw JOIN norm USING (item_id)"""
ORACLES["keyword_features"] = f"WITH {MANUALS} SELECT line_no, " + ", ".join(
    f"CAST(len({_role(r, 'line')}) AS INTEGER) AS kw_{r}" for r in ("strong_procedural", "s_business_sensitive", "ambiguous_action", "weak")) + " FROM ml"
ORACLES["stratified_split"] = f"""WITH {REGRADED}, x AS (SELECT id, label, id::BIGINT % 11 = 0 AS aug FROM regraded WHERE label IN ('C', 'S', 'O')),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('42|' || id)) AS rn, count(*) OVER (PARTITION BY label) AS n FROM x WHERE NOT aug)
SELECT id, label, CASE WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM r UNION ALL SELECT id, label, 'train' FROM x WHERE aug"""
ORACLES["shuffled_split"] = """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256('42|' || doc_id)) <= greatest(1, floor((SELECT count(*) FROM documents) * 0.2)) THEN 'validation' ELSE 'train' END AS part FROM documents"""
ORACLES["balanced_weights"] = f"""WITH {REGRADED}, x AS (SELECT id, label FROM regraded WHERE label IN ('C', 'S', 'O')), c AS (SELECT label, count(*) AS n FROM x GROUP BY label)
SELECT id, label, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n::DOUBLE), 6)::DOUBLE AS weight FROM x JOIN c USING (label)"""

PAIRS = f"""{LINES},{hits_cte('lines')}, tr AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'C' WHEN quality = 0 THEN 'S' ELSE 'O' END AS truth FROM labels),
gr AS (SELECT doc_id, max({_GRADE_RANK}) AS g FROM hits GROUP BY doc_id),
pairs AS (SELECT t.doc_id, t.truth, CASE coalesce(g, 0) WHEN 3 THEN 'C' WHEN 2 THEN 'S' ELSE 'O' END AS pred,
  CASE d.n_chars % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'S' ELSE 'O' END AS pred_b FROM tr t JOIN documents d USING (doc_id) LEFT JOIN gr USING (doc_id)
  WHERE EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = t.doc_id))"""
ORACLES["confusion_matrix"] = f"""WITH RECURSIVE {PAIRS} SELECT g AS true_grade, """ + ", ".join(
    f"CAST(count(*) FILTER (truth = g AND pred_b = '{p}') AS BIGINT) AS pred_{p}" for p in "CSO") + " FROM (VALUES ('C'), ('S'), ('O')) v(g), pairs GROUP BY g"
ORACLES["class_report"] = f"""WITH RECURSIVE {PAIRS}, c AS (SELECT g AS grade, count(*) FILTER (truth = g AND pred_b = g) AS correct_count, count(*) FILTER (truth = g) AS true_count,
  count(*) FILTER (pred_b = g) AS pred_count FROM (VALUES ('C'), ('S'), ('O')) v(g), pairs GROUP BY g),
r AS (SELECT *, CASE WHEN pred_count = 0 THEN 0.0::DOUBLE ELSE correct_count / pred_count::DOUBLE END AS p, CASE WHEN true_count = 0 THEN 0.0::DOUBLE ELSE correct_count / true_count::DOUBLE END AS rc FROM c)
SELECT grade, correct_count, true_count, pred_count, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc = 0 THEN 0.0::DOUBLE ELSE 2 * p * rc / (p + rc) END, 6) AS f1 FROM r"""
ORACLES["grade_report"] = f"""WITH r AS ({ORACLES['class_report']}) SELECT grade, true_count, correct_count,
  printf('%.6f', CASE WHEN true_count = 0 THEN 0.0 ELSE correct_count / true_count::DOUBLE END)::DOUBLE AS recall FROM r"""
_MODELS = "two AS (SELECT 'rules' AS model, truth, pred FROM pairs UNION ALL SELECT 'length', truth, pred_b FROM pairs)"
ORACLES["model_comparison"] = f"""WITH RECURSIVE {PAIRS},{_MODELS} SELECT model, printf('%.6f', count(*) FILTER (truth = pred) / count(*)::DOUBLE)::DOUBLE AS accuracy, """ + ", ".join(
    f"printf('%.6f', count(*) FILTER (truth = '{g}' AND pred = '{g}') / count(*) FILTER (truth = '{g}')::DOUBLE)::DOUBLE AS recall_{g}" for g in "CSO") + ", " + ", ".join(
    f"count(*) FILTER (pred = '{g}') AS pred_{g}" for g in "CSO") + " FROM two GROUP BY model"
ORACLES["best_model"] = f"""WITH m AS ({ORACLES['model_comparison']}) SELECT model, accuracy FROM m ORDER BY accuracy DESC, model LIMIT 1"""
ORACLES["misclassified_rows"] = f"""WITH RECURSIVE {PAIRS} SELECT doc_id, truth, pred, pred_b, CASE WHEN truth <> pred THEN 'Y' ELSE 'N' END AS pred_wrong,
  CASE WHEN truth <> pred_b THEN 'Y' ELSE 'N' END AS pred_b_wrong FROM pairs WHERE truth <> pred OR truth <> pred_b"""
ORACLES["missed_and_false_alarms"] = f"""WITH RECURSIVE {PAIRS} SELECT doc_id, CASE WHEN truth = 'O' THEN 'false_alarm' ELSE 'missed' END AS slice FROM pairs WHERE (truth = 'O') <> (pred_b = 'O')"""

# --- feedback --------------------------------------------------------------------------------------------------------------------

ORACLES["feedback_flags"] = f"""WITH {FEEDBACK} SELECT doc_id, "aiGrade", "userGrade", agree AS "isAgreement", fp AS "isFalsePositive",
  CASE WHEN fp THEN 'false_positive' WHEN NOT agree THEN 'mismatch' ELSE 'agreement' END AS event FROM fb"""
ORACLES["feedback_overall"] = f"""WITH {FEEDBACK}, c AS (SELECT count(*) AS total, count(*) FILTER (agree) AS agreements, count(*) FILTER (fp) AS false_positives FROM fb)
SELECT *, total - agreements AS mismatches, printf('%.3f', agreements / total::DOUBLE)::DOUBLE AS agreement_rate, printf('%.3f', false_positives / total::DOUBLE)::DOUBLE AS false_positive_rate,
  printf('%.3f', (total - agreements) / total::DOUBLE)::DOUBLE AS mismatch_rate FROM c"""
ORACLES["feedback_store_stats"] = f"""WITH c AS ({ORACLES['feedback_overall']}) SELECT total, agreements, false_positives, agreement_rate FROM c"""
_GROUPS = " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {e} AS value, count(*) AS total, count(*) FILTER (agree) AS agreements, count(*) FILTER (fp) AS false_positives FROM fb GROUP BY 2"
    for d, e in (("file_type", "coalesce(\"fileType\", 'unknown')"), ("ai_grade", "coalesce(\"aiGrade\", 'None')"), ("feedback_date", "feedback_date")))
ORACLES["feedback_groups"] = f"WITH {FEEDBACK} {_GROUPS}"
ORACLES["feedback_rates"] = f"""WITH {FEEDBACK}, g AS ({_GROUPS}) SELECT dimension, value, printf('%.1f', agreements / total::DOUBLE * 100) || '%' AS agreement,
  printf('%.1f', false_positives / total::DOUBLE * 100) || '%' AS false_positive FROM g"""
ORACLES["feedback_mismatches"] = f"""WITH {FEEDBACK} SELECT coalesce("aiGrade", '?') AS ai_grade, "userGrade" AS user_grade, coalesce("fileType", '?') AS file_type,
  replace(substr(context, 1, 40), chr(10), ' ') AS context FROM fb WHERE NOT agree ORDER BY doc_id LIMIT 10"""
_RETRAIN = f"""{FEEDBACK}, rt AS (SELECT *, trim(context) AS text, CASE WHEN agree THEN "aiGrade" WHEN fp THEN 'O' ELSE "userGrade" END AS label,
  CASE WHEN agree THEN 'agreement' WHEN fp THEN 'fp_correction' ELSE 'grade_correction' END AS source FROM fb), rr AS (SELECT * FROM rt WHERE text <> '' AND label IN ('C', 'S', 'O'))"""
ORACLES["retrain_set"] = f"""WITH {_RETRAIN} SELECT text, label, source, "fileType" AS file_type, feedback_date AS date FROM rr"""
ORACLES["retrain_counts"] = f"""WITH {_RETRAIN} SELECT 'label' AS kind, label AS value, count(*) AS n FROM rr GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM rr GROUP BY 2"""
ORACLES["feedback_latest"] = f"""WITH {FEEDBACK} SELECT doc_id, context FROM fb WHERE feedback_date = '2026-05-05' ORDER BY doc_id DESC LIMIT 5"""
ORACLES["feedback_rejects"] = f"""WITH {FEEDBACK} SELECT CASE WHEN doc_id % 31 = 0 THEN 'locationLabel is required' WHEN doc_id % 37 = 0 THEN 'userGrade must be one of C, S, O, X'
  WHEN doc_id % 43 = 0 THEN 'userGrade is required' ELSE '' END AS error, count(*) AS n FROM fb GROUP BY 1"""
ORACLES["delimited_rows"] = """
SELECT doc_id, 4 AS n_cells, CASE WHEN doc_id % 2 = 0 THEN ',' ELSE ';' END AS delimiter, lang, md5(coalesce(text, '')) AS text_md5, '"' || source || '", ;' AS source FROM documents"""
ORACLES["routed_files"] = """
WITH p AS (SELECT p_partkey, '/in.v1/' || replace(p_name, ' ', '_') || CASE p_partkey % 7 WHEN 0 THEN '.XLSX' WHEN 1 THEN '.csv' WHEN 2 THEN '.docx' WHEN 3 THEN '.hwp' WHEN 4 THEN '' WHEN 5 THEN '.tar.pdf' ELSE '.pptx' END AS path,
  CASE p_partkey % 7 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'csv' WHEN 2 THEN 'docx' WHEN 5 THEN 'pdf' WHEN 6 THEN 'pptx' END AS file_type FROM part)
SELECT *, CASE WHEN file_type IN ('xlsx', 'csv') THEN 'applied' WHEN file_type IS NOT NULL THEN 'guide' END AS apply_mode, CASE WHEN file_type IS NULL THEN 'UNSUPPORTED_FILE_TYPE' END AS error FROM p"""
ORACLES["streamed_daily_feedback"] = """
WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS feedback_date, CASE event_id % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'S' ELSE 'O' END AS a,
  CASE WHEN event_id % 5 = 0 THEN 'X' WHEN event_id % 5 = 1 THEN 'S' WHEN event_id % 5 = 2 THEN 'C' WHEN event_id % 17 = 3 THEN '?' ELSE 'O' END AS u, event_type FROM events)
SELECT feedback_date, count(*) AS total, count(*) FILTER (a = u) AS agreements, count(*) FILTER (u = 'X') AS false_positives FROM e WHERE u <> '?' AND event_type IS NOT NULL GROUP BY 1"""
ORACLES["streamed_feedback_store"] = """
WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id % 31 <> 0 AS located, event_type, CASE event_id % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'S' ELSE 'O' END AS a,
  CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'X' WHEN event_id % 5 = 1 THEN 'S' WHEN event_id % 17 = 3 THEN '?' ELSE 'O' END AS u FROM events),
j AS (SELECT *, CASE WHEN NOT located THEN 'locationLabel is required' WHEN event_type IS NULL THEN 'context is required' WHEN u IS NULL THEN 'userGrade is required'
  WHEN u = '?' THEN 'userGrade must be one of C, S, O, X' ELSE '' END AS error FROM e)
SELECT error, CASE WHEN error = '' THEN day ELSE '' END AS feedback_date, count(*) AS n, count(*) FILTER (error = '' AND a = u) AS agreements,
  count(*) FILTER (error = '' AND u = 'X') AS false_positives FROM j GROUP BY ALL"""
