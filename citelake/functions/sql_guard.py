"""Validation of generated SQL: one bounded read-only statement over known tables and columns."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

MAX_CHARS, DEFAULT_ROWS, MAX_ROWS = 1500, 50, 100
# Words that change state or reach outside the tables.
FORBIDDEN = frozenset("insert update delete merge create drop alter truncate replace load cache uncache refresh set reset use grant revoke call execute explain describe show analyze add reflect java_method".split())


class Rejected(ValueError):
    pass


def mask(sql: str) -> str:
    """The statement with string literals blanked out."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", sql)


def validate(spark: SparkSession, sql: str, tables: set[str]) -> str:
    """The statement with a row bound, or Rejected with the reason. Nothing is executed."""
    text = sql.strip().rstrip(";").strip()
    if not text or len(text) > MAX_CHARS:
        raise Rejected("empty or longer than 1500 characters")
    bare = mask(text)
    for sign, why in ((";", "more than one statement"), ("--", "comment"), ("/*", "comment"), ("`", "quoted identifier"), ("$", "parameter"), ("${", "parameter")):
        if sign in bare:
            raise Rejected(why)
    words = re.findall(r"[a-z_]+", bare.lower())
    if not words or words[0] not in ("select", "with"):
        raise Rejected("does not start with a read")
    if bad := FORBIDDEN.intersection(words):
        raise Rejected(f"forbidden word: {min(bad)}")
    if "recursive" in words:
        raise Rejected("recursion")
    jvm = spark._jsparkSession
    try:
        plan = jvm.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise Rejected("does not parse") from e
    named = set(re.findall(r"'UnresolvedRelation \[([^\]]+)\]", plan.toString()))
    local = set(re.findall(r"(\w+)\s+as\s*\(", bare.lower()))
    if unknown := {n.lower() for n in named} - {t.lower() for t in tables} - local:
        raise Rejected(f"unknown table: {min(unknown)}")
    try:
        spark.sql(text).schema  # a read is analysed, not run
    except Exception as e:
        raise Rejected("does not analyse: " + str(e).splitlines()[0][:160]) from e
    limit = re.search(r"\blimit\s+(\d+)\s*$", bare, re.I)
    if limit is None:
        return f"{text} LIMIT {DEFAULT_ROWS}"
    if int(limit[1]) > MAX_ROWS:
        raise Rejected("limit over 100")
    return text
