"""SQL spellings of the text expressions, for the checking queries."""

from __future__ import annotations

from logvigil.functions import fixed_values as V


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SPACE = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def strip(x: str) -> str:
    return f"trim({x}, {SPACE})"


def clean(x: str) -> str:
    return f"CASE WHEN {strip(x)} NOT IN ({', '.join(_s(t) for t in V.NULL_TOKENS)}) THEN {strip(x)} END"


def extract(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {_s(pattern)}, {group}), '')"


def first_ip(x: str) -> str:
    return extract(x, rf"\b{V.IPV4}\b", 0)


def has_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {_s(w)})" for w in words) + ")"


def keyword_case(x: str, table: list[tuple[str, list[str]]], default: str) -> str:
    whens = " ".join(f"WHEN {has_any(f'lower({x})', words)} THEN {_s(name)}" for name, words in table)
    return f"CASE {whens} ELSE {_s(default)} END"


def status_from_text(x: str) -> str:
    return keyword_case(x, [("FAILED", V.FAILED_WORDS), ("SUCCESS", V.SUCCESS_WORDS), ("INFO", V.INFO_WORDS)], "UNKNOWN")


def event_type_from_text(x: str) -> str:
    return keyword_case(x, V.EVENT_TYPE_WORDS, "security_event")


def severity_from_text(x: str) -> str:
    return keyword_case(x, V.SEVERITY_WORDS, "UNKNOWN")


def username(x: str) -> str:
    return "coalesce(" + ", ".join(extract(x, "(?i)" + p) for p in V.USERNAME_PATTERNS) + ")"


def normalize_status(x: str) -> str:
    key = f"lower({strip(f'''regexp_replace({clean(x)}, '[\\s_-]+', ' ', 'g')''')})"
    whens = " ".join(f"WHEN {_s(k)} THEN {_s(v)}" for k, v in V.STATUS_ALIASES.items())
    return f"coalesce(CASE {key} {whens} ELSE upper({key}) END, 'UNKNOWN')"


def normalize_event_type(x: str) -> str:
    slug = f"regexp_replace({clean(x)}, '[^a-zA-Z0-9]+', '_', 'g')"
    return f"coalesce(nullif(lower(trim({slug}, '_')), ''), 'security_event')"


def ts_z(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%SZ')"


def csv_guard(x: str) -> str:
    text = f"regexp_replace(coalesce(CAST({x} AS VARCHAR), ''), '\\r?\\n', ' ', 'g')"
    guarded = f"CASE WHEN regexp_matches({text}, '^[=+\\-@]') THEN '''' || {text} ELSE {text} END"
    return f"'\"' || replace({guarded}, '\"', '\"\"') || '\"'"


def display_id(prefix: str, x: str) -> str:
    return f"'{prefix}-' || CASE WHEN {x} < 10000 THEN lpad(CAST({x} AS VARCHAR), 4, '0') ELSE CAST({x} AS VARCHAR) END"


def joined(x: str) -> str:
    return f"array_to_string({x}, ',')"
