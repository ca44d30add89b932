"""Read-only SQL: one statement of an allowed kind, no denied function, no sensitive column, a row cap."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Functions that a read-only path must not call.
DENIED = ["load_file", "sleep", "benchmark", "get_lock", "release_lock", "release_all_locks", "is_free_lock", "is_used_lock", "master_pos_wait", "source_pos_wait", "reflect", "java_method"]
DEFAULT_ROWS, MOST_ROWS = 100, 500
_ALLOWED = re.compile(r"(?is)^\s*(with|select|show|describe|desc|explain|\(|values)\b|^\s*\(")


@dataclass
class Parsed:
    error: str | None = None
    tables: set[str] = field(default_factory=set)
    columns: set[str] = field(default_factory=set)
    wildcard: bool = False


def _masked(sql: str) -> str:
    """Without strings and comments."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'|--[^\n]*|/\*.*?\*/", lambda m: "''" if m.group()[0] == "'" else " ", sql, flags=re.S)


def inspect(spark: SparkSession, sql: str | None) -> Parsed:
    """Judges a statement by Spark's own parser and by the words outside strings and comments."""
    if not sql or not sql.strip():
        return Parsed("sql is required")
    text = _masked(sql).strip().rstrip(";").strip()
    if ";" in text:
        return Parsed("exactly one statement is allowed")
    if not _ALLOWED.match(text):
        return Parsed("only SELECT, SHOW, DESCRIBE and EXPLAIN are allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";")).toString()
    except Exception as e:  # noqa: BLE001 - the parser's own error
        return Parsed(f"not parsed: {str(e).splitlines()[0][:200]}")
    if re.match(r"(?is)^\s*with\b.*\b(insert|update|delete|merge)\b\s+(into|overwrite|from|\w+\s+set)\b", text) or re.search(r"(?i)^'?(insert|create|drop|alter|update|delete|merge|truncate|load|cache|set)\w*", plan):
        return Parsed("only SELECT, SHOW, DESCRIBE and EXPLAIN are allowed")
    if re.match(r"(?is)^explain\b", text):
        rest = re.sub(r"(?is)^explain\s+(extended|codegen|cost|formatted|logical)?\s*", "", text)
        return inspect(spark, rest)
    for f in DENIED:
        if re.search(rf"(?i)\b{f}\s*\(", text):
            return Parsed(f"the function {f} is not allowed")
    if re.search(r"(?is)\bselect\b.*\binto\b", text) and not re.search(r"(?i)\binsert\b", text):
        return Parsed("SELECT INTO is not allowed")
    ctes = {c.lower() for c in re.findall(r"(?i)(?:\bwith|,)\s+`?(\w+)`?\s+as\s*\(", text)}
    tables = {t.lower() for t in re.findall(r"(?i)\b(?:from|join)\s+`?([\w.]+)`?", text)} - ctes
    words = {w.lower() for w in re.findall(r"(?<![\w.])(?:\w+\.)?([A-Za-z_]\w*)(?!\s*\()", text)}
    wildcard = bool(re.search(r"(?i)(\bselect\s+(distinct\s+)?|,\s*|\.)\*", text))
    return Parsed(None, {t.split(".")[-1] for t in tables}, words, wildcard)


def denied_column(policy: list[dict], source: str, tables: set[str], column: str) -> bool:
    """policy rows: source, table, column, allowed; * stands for any. Denied where a row matches and none allows."""
    hit = [r for r in policy if r["column"].lower() == column.lower() and r["source"] in ("*", source) and (r["table"] == "*" or r["table"].lower() in tables)]
    return bool(hit) and not any(r["allowed"] for r in hit)


def check_policy(policy: list[dict], source: str, parsed: Parsed) -> str | None:
    for c in sorted(parsed.columns):
        if denied_column(policy, source, parsed.tables, c):
            return f"column {c} is sensitive"
    if parsed.wildcard:
        scope = {r["column"] for r in policy if r["source"] in ("*", source) and (r["table"] == "*" or r["table"].lower() in parsed.tables)}
        if any(denied_column(policy, source, parsed.tables, c) for c in scope):
            return "select the columns explicitly: a table has sensitive ones"
    return None


def run(spark: SparkSession, sql: str, policy: list[dict] | None = None, source: str = "*", rows: int = DEFAULT_ROWS) -> DataFrame:
    """The statement's result, cut to at most MOST_ROWS rows, as the feature asks; raises PermissionError otherwise."""
    parsed = inspect(spark, sql)
    why = parsed.error or check_policy(policy or [], source, parsed)
    if why:
        raise PermissionError(why)
    return spark.sql(sql.strip().rstrip(";")).limit(min(max(rows, 1), MOST_ROWS))
