"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ORDER = ["ordinal", "ordinal2", "ordinal3"]
ORD = "ordinal, ordinal2, ordinal3"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL twin if it has one."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


# SQL of the scoring formula over (level, verdict, rule_id, weight).
SEVERITY_SQL = "CASE level WHEN 'error' THEN 1.0::DOUBLE WHEN 'warning' THEN 0.6 WHEN 'note' THEN 0.3 WHEN 'none' THEN 0.1 ELSE 0.3 END"
LABEL_SQL = "CASE WHEN verdict IN ('CONFIRMED', 'FALSE_POSITIVE', 'NEEDS_CONTEXT') THEN lower(verdict) ELSE 'sast_only' END"
CONFIDENCE_SQL = "CASE verdict WHEN 'CONFIRMED' THEN 1.0::DOUBLE WHEN 'FALSE_POSITIVE' THEN 0.0 WHEN 'NEEDS_CONTEXT' THEN 0.5 ELSE 0.7 END"
EXPOSURE_SQL = "CASE WHEN weight IS NULL THEN 0.3::DOUBLE ELSE greatest(0.1::DOUBLE, weight / 10.0::DOUBLE) END"
BAND_SQL = "CASE WHEN priority >= 0.7 THEN 'URGENT' WHEN priority >= 0.4 THEN 'ELEVATED' WHEN priority >= 0.2 THEN 'MODERATE' ELSE 'LOW' END"


def scored_sql(source: str, name: str = "scored") -> str:
    """CTE that scores a table of findings."""
    return f"""{name} AS (SELECT *, {BAND_SQL} AS band FROM (
      SELECT f.*, {SEVERITY_SQL} AS severity_score, {CONFIDENCE_SQL} AS confidence_score, {LABEL_SQL} AS confidence_label,
        {EXPOSURE_SQL} AS exposure, round({SEVERITY_SQL} * {CONFIDENCE_SQL} * {EXPOSURE_SQL}, 3) AS priority
      FROM {source} f LEFT JOIN manifest m ON f.file = m.file))"""


RANK_SQL = "CASE level WHEN 'error' THEN 4 WHEN 'warning' THEN 3 WHEN 'note' THEN 2 WHEN 'none' THEN 1 ELSE 0 END"
DEDUP_SQL = f"""deduped AS (SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY coalesce(cwe, rule_id), file, line ORDER BY {RANK_SQL} DESC, {ORD}) AS rn,
      first_value(ordinal) OVER (PARTITION BY coalesce(cwe, rule_id), file, line ORDER BY {ORD}) AS first_ordinal
    FROM findings) WHERE rn = 1)"""
