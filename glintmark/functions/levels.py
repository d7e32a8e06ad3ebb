"""Levels, verdicts, priority score and bands as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from glintmark.functions import constants as K


def lookup(table: dict, key: Column) -> Column:
    """Value of ``key`` in a literal map, null when absent."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[key]


def level_rank(level: Column) -> Column:
    """Rank of a level; a missing level counts as ``none``, an unknown one as 0."""
    return F.coalesce(lookup(K.LEVEL_RANK, F.lower(F.coalesce(level, F.lit("none")))), F.lit(0))


def resolve_level(level: Column, issue_severity: Column, rule_level: Column, tool: Column) -> Column:
    """Own level, else the scanner's severity word, else the rule's default, else the tool's, else warning."""
    return F.coalesce(
        lookup(K.SEVERITY_LEVEL, F.lower(level)),
        lookup(K.SEVERITY_LEVEL, F.lower(issue_severity)),
        lookup(K.SEVERITY_LEVEL, F.lower(rule_level)),
        lookup(K.TOOL_LEVEL, F.lower(tool)),
        F.lit(K.FALLBACK_LEVEL),
    )


def advisory_level(severity: Column) -> Column:
    return F.coalesce(lookup(K.ADVISORY_LEVEL, F.lower(severity)), F.lit(K.FALLBACK_LEVEL))


def severity_to_level(severity: Column) -> Column:
    """Level of a model finding's severity word."""
    words = {w: K.SEVERITY_LEVEL[w.lower()] for w in K.SEVERITY_ORDER}
    return F.coalesce(lookup(words, severity), F.lit(K.FALLBACK_LEVEL))


def severity_at_least(actual: Column, minimum: Column) -> Column:
    rank = lambda c: F.coalesce(lookup(K.SEVERITY_ORDER, F.upper(c)), F.lit(0))
    return rank(actual) >= rank(minimum)


def exposure(weight: Column) -> Column:
    """Exposure of a file from its weight; a file outside the manifest has a fixed one."""
    return F.when(weight.isNull(), F.lit(K.EXPOSURE_UNKNOWN_FILE)).otherwise(
        F.greatest(F.lit(K.EXPOSURE_MIN), weight / F.lit(10.0))
    )


def effective_verdict(verdict: Column, rule_id: Column, verification: bool) -> Column:
    """Verdict used for scoring: a model finding without one is confirmed only if nothing verifies it."""
    default = "NEEDS_CONTEXT" if verification else "CONFIRMED"
    missing = verdict.isNull() | (verdict == "")
    return F.when(missing & rule_id.startswith("SR-"), F.lit(default)).otherwise(verdict)


def confidence_label(verdict: Column, rule_id: Column) -> Column:
    """Label from the verdict, else from how the finding was detected."""
    word = F.lower(verdict)
    return F.when(word.isin([v.lower() for v in K.VERDICTS]), word).otherwise(
        F.when(rule_id.startswith("SR-"), F.lit("llm_only")).otherwise(F.lit("sast_only"))
    )


def severity_score(level: Column) -> Column:
    return F.coalesce(lookup(K.SEVERITY_SCORE, F.lower(level)), F.lit(K.SEVERITY_SCORE_OTHER))


def confidence_score(label: Column) -> Column:
    return F.coalesce(lookup(K.CONFIDENCE_SCORE, label), F.lit(K.CONFIDENCE_SCORE_OTHER))


def band(priority: Column) -> Column:
    """Band of the rounded priority."""
    expr = F.lit(K.BANDS[-1][0])
    for name, low in reversed(K.BANDS[:-1]):
        expr = F.when(priority >= low, F.lit(name)).otherwise(expr)
    return expr


def band_rank(name: Column) -> Column:
    return F.coalesce(lookup(K.BAND_RANK, name), F.lit(0))


def display_level(level: Column) -> Column:
    return F.coalesce(lookup(K.LEVEL_DISPLAY, level), level)


def display_verdict(verdict: Column) -> Column:
    return F.coalesce(lookup(K.VERDICT_DISPLAY, verdict), F.lit("Untriaged"))
