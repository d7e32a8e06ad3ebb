"""Queries over findings: dedup, score, filter, suppress, report."""

from pyspark.sql import functions as F

from glintmark.functions import levels as L
from glintmark.functions import tags as T
from glintmark.functions.paths import normal_uri
from glintmark.operators import dedup, history, reports, scoring
from glintmark.plans.catalog.registry import (
    DEDUP_SQL, EXPOSURE_SQL, ORD, ORDER, SEVERITY_SQL, query, scored_sql,
)
from glintmark.plans.views import sql_with, view
from glintmark.session import settle

_F = sql_with("findings")
_FM = sql_with("findings", "manifest")


def _scored(spark, sf):
    """Findings with their score. The manifest is written first: Spark then knows its size, and shuffles no finding to meet a small one."""
    return scoring.score(scoring.with_exposure(view(spark, sf, "findings"), settle(view(spark, sf, "manifest"), "manifest")))


@query(f"""{_F}, {DEDUP_SQL}
SELECT {ORD}, tool, rule_id, cwe, file, line, level, first_ordinal FROM deduped""")
def dedup_findings(spark, sf):
    out = dedup.dedup_findings(view(spark, sf, "findings"), ORDER)
    return out.select(*ORDER, "tool", "rule_id", "cwe", "file", "line", "level",
                      F.col("position.ordinal").alias("first_ordinal"))


@query(f"""{_FM}, {DEDUP_SQL}, {scored_sql('deduped')}
SELECT run_no, band, count(*) AS n, round(sum(priority), 6) AS sum_priority, max(priority) AS max_priority
FROM scored GROUP BY run_no, band""")
def score_bands(spark, sf):
    unique = dedup.dedup_findings(view(spark, sf, "findings"), ORDER)
    scored = scoring.score(scoring.with_exposure(unique, view(spark, sf, "manifest")))
    return scored.groupBy("run_no", "band").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("priority"), 6).alias("sum_priority"),
        F.max("priority").alias("max_priority"))


@query(f"""{_FM}, {scored_sql('findings')}
SELECT {ORD}, priority, band, severity_score, confidence_score, confidence_label, exposure FROM scored""")
def scored_findings(spark, sf):
    return _scored(spark, sf).select(
        *ORDER, "priority", "band", "severity_score", "confidence_score", "confidence_label", "exposure")


@query(f"""{_FM}, {scored_sql('findings')}
SELECT run_no, band, {ORD}, priority, rank_no FROM (
  SELECT *, row_number() OVER (PARTITION BY run_no, band ORDER BY priority DESC, {ORD}) AS rank_no FROM scored)""")
def band_ranks(spark, sf):
    return reports.band_ranks(_scored(spark, sf), ["run_no"], ORDER).select("run_no", "band", *ORDER, "priority", "rank_no")


@query(f"""{_FM}, {scored_sql('findings')}
SELECT run_no, {ORD}, priority, band, rank_no FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY run_no ORDER BY priority DESC, {ORD}) AS INT) AS rank_no FROM scored)
WHERE rank_no <= 20""")
def top_findings_per_run(spark, sf):
    return reports.top_ranked(_scored(spark, sf), ["run_no"], ORDER, 20).select(
        "run_no", *ORDER, "priority", "band", "rank_no")


@query(f"""{_F} SELECT cwe, count(*) AS n FROM findings WHERE cwe IS NOT NULL GROUP BY cwe ORDER BY n DESC, min(({ORD})) LIMIT 10""")
def cwe_top10(spark, sf):
    return reports.top_cwes(view(spark, sf, "findings"), ORDER)


@query(f"""{_FM} SELECT {ORD}, file FROM findings WHERE file IN (SELECT file FROM manifest)""")
def manifest_semi(spark, sf):
    return scoring.in_manifest(view(spark, sf, "findings"), view(spark, sf, "manifest")).select(*ORDER, "file")


@query(f"""{_FM} SELECT run_no, count(*) AS n_dropped FROM findings WHERE file NOT IN (SELECT file FROM manifest) GROUP BY run_no""")
def manifest_dropped(spark, sf):
    out = scoring.outside_manifest(view(spark, sf, "findings"), view(spark, sf, "manifest"))
    return out.groupBy("run_no").agg(F.count(F.lit(1)).alias("n_dropped"))


@query(f"""{sql_with('findings', 'model_findings')}
SELECT {ORD}, rule_id, file, line, cwe, severity FROM (
  SELECT *, row_number() OVER (PARTITION BY rule_id, file, coalesce(line, 0) ORDER BY {ORD}) AS rn FROM model_findings m
  WHERE cwe IS NOT NULL AND NOT EXISTS (SELECT 1 FROM findings f WHERE f.line > 0 AND f.file = m.file AND f.line = m.line))
WHERE rn = 1""")
def cross_source_suppress(spark, sf):
    fresh = dedup.suppress_reported(view(spark, sf, "model_findings"), view(spark, sf, "findings"))
    return dedup.dedup_model_findings(fresh, ORDER).select(*ORDER, "rule_id", "file", "line", "cwe", "severity")


@query(f"""{_FM}, pre AS (SELECT *, {EXPOSURE_SQL} AS exposure, round({SEVERITY_SQL} * 0.7::DOUBLE * {EXPOSURE_SQL}, 3) AS priority
  FROM findings f LEFT JOIN manifest m ON f.file = m.file)
SELECT run_no, count(*) FILTER (priority >= 0.2) AS kept, count(*) FILTER (priority < 0.2) AS skipped FROM pre GROUP BY run_no""")
def score_prefilter(spark, sf):
    return scoring.triage_counts(scoring.prescore(view(spark, sf, "findings"), view(spark, sf, "manifest")), ["run_no"])


_LEVEL_WORDS = """CASE lower({0}) WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note'
 WHEN 'informational' THEN 'note' WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' WHEN 'note' THEN 'note' WHEN 'none' THEN 'note' END"""
_RAW = """raw AS (SELECT ordinal, ordinal2, ordinal3, rule_id, CASE tool WHEN 'tool_a' THEN 'bandit' WHEN 'tool_n' THEN 'roslyn' ELSE 'other' END AS tool,
  CASE WHEN ordinal % 5 < 2 THEN level WHEN ordinal % 5 = 2 THEN 'odd' END AS level,
  CASE WHEN ordinal % 3 = 0 THEN 'HIGH' WHEN ordinal % 3 = 1 THEN 'strange' END AS issue_severity FROM findings)"""
_RULES = "rules AS (SELECT DISTINCT rule_id, CASE WHEN rule_id LIKE '%1' THEN 'Error' WHEN rule_id LIKE '%2' THEN 'note' END AS default_level FROM findings)"


def _raw(spark, sf):
    tool = F.col("tool")
    m5, m3 = F.col("ordinal") % 5, F.col("ordinal") % 3
    f = view(spark, sf, "findings")
    raw = f.select(
        *ORDER, "rule_id",
        F.when(tool == "tool_a", "bandit").when(tool == "tool_n", "roslyn").otherwise("other").alias("tool"),
        F.when(m5 < 2, F.col("level")).when(m5 == 2, F.lit("odd")).alias("level"),
        F.when(m3 == 0, F.lit("HIGH")).when(m3 == 1, F.lit("strange")).alias("issue_severity"))
    rules = f.select("rule_id").distinct().withColumn(
        "default_level", F.when(F.col("rule_id").endswith("1"), "Error").when(F.col("rule_id").endswith("2"), "note"))
    return raw, rules


@query(f"""{_F}, {_RAW}, {_RULES}
SELECT {ORD}, coalesce({_LEVEL_WORDS.format('level')}, {_LEVEL_WORDS.format('issue_severity')}, {_LEVEL_WORDS.format('default_level')},
  CASE tool WHEN 'bandit' THEN 'warning' WHEN 'roslyn' THEN 'note' END, 'warning') AS level
FROM raw LEFT JOIN rules USING (rule_id)""")
def level_resolve(spark, sf):
    raw, rules = _raw(spark, sf)
    attributes = scoring.rule_attributes(rules.withColumn("tags", F.lit(None).cast("array<string>")), [])
    return scoring.resolve_levels(raw, attributes, []).select(*ORDER, "level")


@query(f"""{_F}, rules AS (SELECT DISTINCT rule_id, CASE WHEN rule_id LIKE '%3' THEN 'CWE-79' WHEN rule_id LIKE '%4' THEN 'CWE-7' END AS rule_cwe FROM findings)
SELECT {ORD}, coalesce(cwe, rule_cwe) AS cwe FROM findings LEFT JOIN rules USING (rule_id)""")
def rule_cwe_lookup(spark, sf):
    f = view(spark, sf, "findings")
    tag = F.when(F.col("rule_id").endswith("3"), "external/cwe/cwe-079").when(F.col("rule_id").endswith("4"), "external/cwe/cwe-007")
    rules = f.select("rule_id").distinct().select(
        "rule_id", F.lit(None).cast("string").alias("default_level"),
        F.when(tag.isNotNull(), F.array(F.lit("security"), tag)).alias("tags"))
    return scoring.rule_cwe_fallback(f, scoring.rule_attributes(rules, []), []).select(*ORDER, "cwe")


@query(f"""{_F} SELECT {ORD}, CASE ordinal % 3 WHEN 0 THEN file WHEN 1 THEN file ELSE '/other/' || file END AS path FROM findings""")
def uri_normalise(spark, sf):
    f = view(spark, sf, "findings")
    m = F.col("ordinal") % 3
    raw = F.when(m == 0, F.concat(F.lit("file:///repo/"), "file")).when(m == 1, F.col("file")).otherwise(
        F.concat(F.lit("/other/"), "file"))
    return f.select(*ORDER, normal_uri(raw, "/repo/").alias("path"))


_TAG_RAW = "CASE ordinal % 6 WHEN 0 THEN 'CWE-' || (ordinal2 % 1500) || ': name' WHEN 1 THEN 'external/cwe/cwe-0' || (ordinal2 % 90) WHEN 2 THEN CAST(ordinal2 % 1500 AS VARCHAR) WHEN 3 THEN 'security' WHEN 4 THEN ' CWE-00' || (ordinal2 % 9) ELSE 'owasp-a1' END"


@query(f"""{_F} SELECT {ORD}, CASE WHEN ordinal % 6 IN (0, 2) THEN 'external/cwe/cwe-' || format('{{:03d}}', ordinal2 % 1500)
 WHEN ordinal % 6 = 1 THEN 'external/cwe/cwe-' || format('{{:03d}}', ordinal2 % 90) WHEN ordinal % 6 = 4 THEN 'external/cwe/cwe-00' || (ordinal2 % 9) END AS tag,
 CASE WHEN ordinal % 6 IN (3, 5) THEN 'other|' || ({_TAG_RAW}) ELSE 'other' END AS tags_before_cwe FROM findings""")
def tag_normalise(spark, sf):
    f = view(spark, sf, "findings")
    m, n = F.col("ordinal") % 6, F.col("ordinal2")
    text = lambda c: c.cast("string")
    raw = (
        F.when(m == 0, F.concat(F.lit("CWE-"), text(n % 1500), F.lit(": name")))
        .when(m == 1, F.concat(F.lit("external/cwe/cwe-0"), text(n % 90))).when(m == 2, text(n % 1500))
        .when(m == 3, F.lit("security")).when(m == 4, F.concat(F.lit(" CWE-00"), text(n % 9))).otherwise(F.lit("owasp-a1"))
    )
    tags = T.normal_tags(F.array(F.lit("other"), raw))
    others = F.filter(tags, lambda t: ~t.startswith(T.CWE_TAG))
    return f.select(*ORDER, T.cwe_tag(raw).alias("tag"), F.array_join(others, "|").alias("tags_before_cwe"))


@query(f"""{sql_with('model_findings')} SELECT {ORD},
 'SR-X-' || format('{{:03d}}', ordinal2 % 300) AS rule_id, 'SR-CFG-' || format('{{:03d}}', ordinal2 % 300) AS config_rule_id,
 severity AS severity, CASE WHEN ordinal2 % 5 = 0 THEN 'MEDIUM' WHEN ordinal2 % 5 = 1 THEN 'LOW' ELSE severity END AS priority,
 'CWE-' || (ordinal2 % 2000) AS cwe,
 CASE WHEN ordinal2 % 3 = 0 THEN (CASE WHEN ordinal2 % 101 / 100.0 >= 0.75 THEN 'high' WHEN ordinal2 % 101 / 100.0 >= 0.4 THEN 'medium' ELSE 'low' END) WHEN ordinal2 % 3 = 1 THEN 'high' ELSE 'medium' END AS confidence,
 'A' || format('{{:02d}}', ordinal2 % 11) || CASE WHEN ordinal2 % 2 = 0 THEN ':2017' ELSE ':2021' END AS owasp,
 round(CASE WHEN ordinal2 % 101 > 1 THEN (ordinal2 % 101) / 100.0::DOUBLE ELSE (ordinal2 % 101)::DOUBLE END, 6) AS share,
 CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level
FROM model_findings""")
def field_normalise(spark, sf):
    f = view(spark, sf, "model_findings")
    n = F.col("ordinal2")
    text = lambda c: c.cast("string")
    pct = text(n % 101)
    conf = F.when(n % 3 == 0, text((n % 101) / 100.0)).when(n % 3 == 1, F.lit(" High ")).otherwise(F.lit("unsure"))
    prio = F.when(n % 5 == 0, F.lit("soon")).when(n % 5 == 1, F.lit("informational")).otherwise(F.lower("severity"))
    owasp = F.concat(F.lit("A"), text(n % 11), F.when(n % 2 == 0, F.lit(":2017 x")).otherwise(F.lit(" Injection")))
    severity = T.normal_severity(F.concat(F.lit(" "), F.lower("severity")))
    return f.select(
        *ORDER, T.normal_rule_id(F.concat(F.lit(" sr-x-"), text(n % 300))).alias("rule_id"),
        T.normal_config_rule_id(F.concat(F.lit("cfg "), text(n % 300))).alias("config_rule_id"),
        severity.alias("severity"), T.normal_priority(prio).alias("priority"),
        T.normal_cwe(F.concat(F.lit("cwe"), text(n % 2000))).alias("cwe"), T.confidence_word(conf).alias("confidence"),
        T.owasp_category(owasp).alias("owasp"), F.round(T.confidence_share(F.concat(pct, F.lit("%"))), 6).alias("share"),
        L.severity_to_level(severity).alias("level"))


@query(f"""{sql_with('model_findings')}, src AS (SELECT *, CASE WHEN ordinal2 % 4 = 0 THEN 'unknown' ELSE file END AS f2 FROM model_findings WHERE cwe IS NOT NULL)
SELECT {ORD}, CASE WHEN f2 <> 'unknown' THEN f2 END AS file, CASE WHEN f2 <> 'unknown' THEN coalesce(line, 1) END AS line,
 f2 = 'unknown' AS location_unresolved, title || ': ' || description AS message,
 CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level FROM src""")
def model_locations(spark, sf):
    m = view(spark, sf, "model_findings").filter(dedup.has_cwe(F.col("cwe"))).withColumn(
        "file", F.when(F.col("ordinal2") % 4 == 0, F.lit("unknown")).otherwise(F.col("file")))
    return scoring.model_rows(m).select(*ORDER, "file", "line", "location_unresolved", "message", "level")


@query(f"""{_FM}, {scored_sql('findings')} SELECT run_no, count(*) AS total, count(*) FILTER (band = 'URGENT') AS urgent, count(*) FILTER (band = 'ELEVATED') AS elevated,
 count(*) FILTER (band = 'MODERATE') AS moderate, count(*) FILTER (band = 'LOW') AS low, count(*) FILTER (level = 'error') AS critical,
 count(*) FILTER (level = 'warning') AS medium, count(*) FILTER (level = 'note') AS low_severity, count(*) FILTER (verdict = 'CONFIRMED') AS triage_confirmed,
 count(*) FILTER (verdict = 'FALSE_POSITIVE') AS triage_false_positive, count(*) FILTER (verdict = 'NEEDS_CONTEXT') AS triage_needs_context,
 bool_or(coalesce(verdict <> '', false)) AS has_triage FROM scored GROUP BY run_no""")
def band_counts(spark, sf):
    return reports.report_counts(_scored(spark, sf), ["run_no"])


@query(f"""{_F} SELECT tool, count(*) FILTER (verdict = 'CONFIRMED') AS total_confirmed, count(*) FILTER (verdict = 'FALSE_POSITIVE') AS total_false_positive,
 count(*) FILTER (verdict = 'NEEDS_CONTEXT') AS total_needs_context FROM findings GROUP BY tool""")
def verdict_counts(spark, sf):
    return reports.verdict_totals(view(spark, sf, "findings"), ["tool"])


@query(f"""{_FM}, {scored_sql('findings')} SELECT file, CASE WHEN bool_or(band IN ('URGENT')) THEN 3 WHEN file NOT IN (SELECT file FROM manifest) THEN 4 ELSE 0 END::INT AS gate FROM scored GROUP BY file""")
def band_gate(spark, sf):
    """A gate per file; a file outside the manifest counts as lost."""
    scored = _scored(spark, sf)
    lost = scoring.outside_manifest(scored.select("file").distinct(), view(spark, sf, "manifest"))
    return reports.gate(reports.report_counts(scored, ["file"]), ["file"], "urgent", True, lost)


_STATUS = "CASE verdict WHEN 'CONFIRMED' THEN 'Confirmed' WHEN 'FALSE_POSITIVE' THEN 'False Pos' WHEN 'NEEDS_CONTEXT' THEN 'Needs Ctx' ELSE 'Untriaged' END"
_SHOWN = "CASE level WHEN 'error' THEN 'Critical' WHEN 'warning' THEN 'Medium' WHEN 'note' THEN 'Low' ELSE level END"
_FLAT = "regexp_replace(replace(message, chr(10), ' '), ' +', ' ', 'g')"


@query(f"""{_FM}, {scored_sql('findings')} SELECT band, priority, {_SHOWN} AS severity, {_STATUS} AS status, split_part(file, '/', 3) AS file, line, {_FLAT}[:80] AS finding, message
FROM (SELECT * FROM scored WHERE priority >= 0.2 ORDER BY priority DESC, {ORD} LIMIT 20)""")
def actionable_top20(spark, sf):
    return reports.summary_rows(reports.actionable(_scored(spark, sf), ORDER))


@query(f"""{_FM}, {scored_sql('findings')} SELECT printf('%.3f', priority) AS priority, band AS priority_band, {_SHOWN} AS severity, file, line, rule_id,
 coalesce(cwe, '') AS cwe, coalesce(verdict, 'untriaged') AS status, printf('%.2f', confidence_score) AS confidence, confidence_label,
 printf('%.2f', exposure) AS exposure, {_FLAT} AS message FROM scored""")
def export_rows(spark, sf):
    return reports.export_rows(_scored(spark, sf))


@query(f"""{_F} SELECT rule_id, file, line, CASE WHEN bool_or(run_no = 0) AND bool_or(run_no = 1) THEN 'common' WHEN bool_or(run_no = 0) THEN 'only_a' ELSE 'only_b' END AS side
FROM findings WHERE run_no IN (0, 1) GROUP BY rule_id, file, line""")
def run_diff(spark, sf):
    f = view(spark, sf, "findings")
    return history.key_diff(f.filter("run_no = 0"), f.filter("run_no = 1"), ["rule_id", "file", "line"])


@query(f"""{_F} SELECT tool AS pass, level AS kind, count(*) AS n_events, CAST(sum(line) AS BIGINT) AS n_lost FROM findings GROUP BY tool, level""")
def degradation_rollup(spark, sf):
    losses = view(spark, sf, "findings").select(F.col("tool").alias("pass"), F.col("level").alias("kind"),
                                                F.col("line").cast("bigint").alias("count"))
    return reports.loss_rollup(losses, ["pass", "kind"])


