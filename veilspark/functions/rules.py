"""Identifier rules.

The tables below are fixed values: ids, labels, patterns, grades, actions and descriptions decide
what a detection looks like and must stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

MASK = "마스킹"
DELETE = "삭제"
SUBSTITUTE = "치환"
CATEGORIZE = "범주화"
REVIEW = "검토 필요"


@dataclass(frozen=True)
class Rule:
    id: str
    label: str
    grade: str
    action: str
    pattern: str
    ignore_case: bool = False
    desc: str = ""

    @property
    def java(self) -> str:
        """Pattern with Unicode character classes, so that ``\\d`` and ``\\s`` are not ASCII-only."""
        return ("(?iuU)" if self.ignore_case else "(?U)") + self.pattern


# Base rules, in detection order.
IDENTIFIER_RULES: tuple[Rule, ...] = (
    Rule("rrn", "주민등록번호", "C", DELETE,
         r"(?<!\d)\d{6}[-–]\d{7}(?!\d)",
         desc="고유식별정보 — 외부 AI 입력 금지"),
    Rule("passport", "여권번호", "C", DELETE,
         r"(?<![A-Za-z0-9])[A-Z]{1,2}\d{7,9}(?![A-Za-z0-9])",
         desc="고유식별정보"),
    Rule("ip", "내부 IP 주소", "C", DELETE,
         r"(?<![\d.])(10\.\d{1,3}\.\d{1,3}\.\d{1,3}|172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}"
         r"|192\.168\.\d{1,3}\.\d{1,3})(?![\d.])",
         desc="내부 네트워크 정보 — 사이버 공격 악용 위험"),
    Rule("phone", "전화번호", "S", MASK,
         r"(?<!\d)0\d{1,2}[-–·]?\d{3,4}[-–·]?\d{4}(?!\d)",
         desc="직접 식별 가능한 개인정보"),
    Rule("email", "이메일 주소", "S", MASK,
         r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?![A-Za-z0-9.\-])",
         ignore_case=True, desc="직접 식별 가능한 개인정보"),
    Rule("empid", "사번", "S", MASK,
         r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{6}(?![A-Za-z0-9])",
         desc="사번 — 개인 식별 가능 정보"),
    Rule("account", "계좌번호", "S", MASK,
         r"(?<!\d)(?:\d{3}-\d{2}-\d{4}-\d{3}|\d{4}-\d{3}-\d{6}|\d{3}-\d{6}-\d{5}|\d{3}-\d{2}-\d{6}"
         r"|\d{3}-\d{6}-\d{2}-\d{3}|\d{3}-\d{4}-\d{4}-\d{2}|\d{4}-\d{4}-\d{4}-\d{1}|\d{6}-\d{2}-\d{6}"
         r"|\d{4}-\d{2}-\d{7}|\d{3}-\d{6}-\d{3}|\d{2}-\d{2}-\d{6}|\d{3}-\d{2}-\d{6}-\d{1}"
         r"|\d{3}-\d{4}-\d{4}-\d{3}|\d{10,14})(?!\d)",
         desc="계좌번호 — 은행별 패턴 및 하이픈 없는 10~14자리 포함"),
    Rule("freq", "무선 주파수", "S", SUBSTITUTE,
         r"(?<!\d)\d{2,3}\.\d{3,4}\s*[MG]Hz(?![A-Za-z0-9])",
         ignore_case=True, desc="통신 보안 정보 — 도청·혼신 위험"),
    Rule("coord", "정밀 위치(키로정)", "S", CATEGORIZE,
         r"(?<![A-Za-z0-9])\d{1,3}K\d{3}(?![A-Za-z0-9])",
         ignore_case=True, desc="정밀 위치정보 — 범위로 범주화 권장"),
    Rule("datetime_precise", "정밀 시각", "S", CATEGORIZE,
         r"(?<!\d)([01]\d|2[0-3]):[0-5]\d:[0-5]\d(?!\d)",
         desc="정밀 시각 — 보안 공백과 결합 시 범주화 권장"),
    Rule("credit_card", "신용카드번호", "C", DELETE,
         r"(?<!\d)\d{4}[-\s]\d{4}[-\s]\d{4}[-\s]\d{4}(?!\d)",
         desc="신용·체크카드번호 — 4×4자리 형식"),
    Rule("driver_license", "운전면허번호", "S", DELETE,
         r"(?<!\d)\d{2}-\d{2}-\d{6}-\d{2}(?!\d)",
         desc="운전면허번호 — 시도코드-연도-일련번호-검증"),
    Rule("vlan_port", "VLAN/포트 정보", "C", DELETE,
         r"(?<![A-Za-z0-9])VLAN\s*\d+(?!\d)|(?<![A-Za-z0-9])port\s*\d{2,5}(?!\d)",
         ignore_case=True, desc="내부 네트워크 구성 정보"),
)

# Further rules used when mining a corpus.
MINING_RULES: tuple[Rule, ...] = (
    Rule("ip_masked", "마스킹 IP", "S", MASK, r"\d+\*\.\d+\*(?:\.\d+\*?)*"),
    Rule("ip_any", "IP 주소", "S", MASK, r"(?<!\d)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.])"),
    Rule("phone_repr", "대표번호", "S", MASK, r"(?<!\d)1[0-9]{3}[-–]\d{4}(?!\d)"),
    Rule("phone_area_bracket", "지역번호 괄호식 전화", "S", MASK,
         r"(?<!\d)0\d{1,2}\)\s*\d{3,4}[-–]\d{4}(?!\d)"),
    Rule("account_like", "계정 후보", "S", MASK,
         r"(?:계정|ID|아이디)\s*[:：=]\s*[A-Za-z][A-Za-z0-9_.-]{2,}", ignore_case=True),
    Rule("password_like", "비밀번호 후보", "S", MASK,
         r"(?:비밀번호|password|passwd|pwd)\s*[:：=]\s*\S+", ignore_case=True),
)

# The first mining policy knew only these of the further rules.
EARLY_MINING_RULES = MINING_RULES[:4]
