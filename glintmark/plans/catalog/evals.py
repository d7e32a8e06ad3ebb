"""Queries that measure detectors against ground truth."""

from pyspark.sql import functions as F

from glintmark.operators import evaluation as E
from glintmark.plans.catalog.registry import query
from glintmark.plans.views import sql_with, table, view

_V = sql_with("eval_cases", "eval_truth", "eval_predictions", "eval_runs")
_CONF = """want AS (SELECT DISTINCT t.case_id, file, line FROM eval_truth t WHERE label = 'true_positive'),
w AS (SELECT r.model, r.run_no, want.* FROM want JOIN eval_runs r USING (case_id)),
found AS (SELECT DISTINCT p.model, p.run_no, p.case_id, file, line FROM eval_predictions p JOIN eval_runs r USING (model, run_no, case_id) WHERE variant = 'source' AND line > 0),
scored AS (SELECT w.*, EXISTS (SELECT 1 FROM found f WHERE f.model = w.model AND f.run_no = w.run_no AND f.case_id = w.case_id AND f.file = w.file AND abs(f.line - w.line) <= 1) AS hit FROM w),
s1 AS (SELECT model, run_no, case_id, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fn FROM scored GROUP BY ALL),
s2 AS (SELECT f.model, f.run_no, f.case_id, count(*) AS n_found, count(*) FILTER (NOT EXISTS (SELECT 1 FROM w WHERE f.model = w.model AND f.run_no = w.run_no AND f.case_id = w.case_id AND f.file = w.file AND abs(f.line - w.line) <= 1)) AS n_stray FROM found f GROUP BY ALL),
s3 AS (SELECT model, run_no, case_id, count(*) AS n_patched FROM eval_predictions WHERE variant = 'patched' GROUP BY ALL),
rows AS (SELECT model, run_no, case_id, coalesce(tp, 0) AS tp, coalesce(n_stray, 0) + CASE WHEN has_patched THEN coalesce(n_patched, 0) ELSE 0 END AS fp,
  CASE WHEN has_patched AND n_patched IS NULL THEN 1 ELSE 0 END + CASE WHEN tp IS NULL AND n_found IS NULL THEN 1 ELSE 0 END AS tn, coalesce(fn, 0) AS fn
  FROM eval_runs LEFT JOIN s1 USING (model, run_no, case_id) LEFT JOIN s2 USING (model, run_no, case_id) LEFT JOIN s3 USING (model, run_no, case_id)),
counts AS (SELECT model, run_no, cwe, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fn) AS BIGINT) AS fn FROM rows JOIN eval_cases USING (case_id) GROUP BY ALL
  UNION ALL SELECT model, run_no, 'all', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(tn) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM rows GROUP BY ALL),
m1 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall FROM counts),
m2 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 5.0 * precision * recall / (4.0 * precision + recall) END AS f_beta,
  CASE WHEN (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0.0 END AS mcc,
  recall + CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0.0 END - 1.0 AS youden_j FROM m1)"""


def _counts(spark, sf):
    rows = E.confusion_rows(view(spark, sf, "eval_predictions"), view(spark, sf, "eval_truth"), view(spark, sf, "eval_runs"))
    return E.confusion_rollup(rows, view(spark, sf, "eval_cases"))


@query(f"""{_V}, t AS (SELECT DISTINCT case_id, file, line FROM eval_truth), p AS (SELECT DISTINCT case_id, file, line FROM eval_predictions WHERE variant = 'source')
SELECT t.case_id, t.file, t.line, EXISTS (SELECT 1 FROM p WHERE p.case_id = t.case_id AND p.file = t.file AND p.line BETWEEN t.line - 1 AND t.line + 1) AS hit FROM t""")
def tolerance_match(spark, sf):
    t = view(spark, sf, "eval_truth").select("case_id", "file", "line").distinct()
    return E.matched_truth(t, view(spark, sf, "eval_predictions").filter("variant = 'source'"), ["case_id"])


@query(f"""{_V}, {_CONF} SELECT model, run_no, cwe, tp, fp, tn, fn FROM counts""")
def confusion_rollup(spark, sf):
    return _counts(spark, sf)


_ROUNDED = ["precision", "recall", "f_beta", "mcc", "youden_j"]


@query(f"""{_V}, {_CONF} SELECT model, run_no, cwe, {", ".join(f"round({c}, 6) AS {c}" for c in _ROUNDED)} FROM m2""")
def detection_metrics(spark, sf):
    return E.detection_metrics(_counts(spark, sf)).select(
        "model", "run_no", "cwe", *[F.round(c, 6).alias(c) for c in _ROUNDED])


def _overall(spark, sf):
    return E.detection_metrics(_counts(spark, sf).filter("cwe = 'all'"))


@query(f"""{_V}, {_CONF}, r AS (SELECT model, run_no, f_beta, row_number() OVER (PARTITION BY model ORDER BY f_beta, run_no) AS rn, count(*) OVER (PARTITION BY model) AS n,
 avg(f_beta) OVER (PARTITION BY model) AS mean_f, stddev_pop(f_beta) OVER (PARTITION BY model) AS sd FROM m2 WHERE cwe = 'all')
SELECT model, n AS n_runs, round(mean_f, 6) AS mean_f, round(sd, 6) AS stddev_f, run_no AS median_run, round(f_beta, 6) AS median_f FROM r WHERE rn = n // 2 + 1""")
def run_stability(spark, sf):
    out = E.run_stability(_overall(spark, sf))
    return out.select("model", "n_runs", *[F.round(c, 6).alias(c) for c in ("mean_f", "stddev_f", "median_f")], "median_run")


@query(f"""{_V}, {_CONF}, r AS (SELECT model, f_beta, row_number() OVER (PARTITION BY model ORDER BY f_beta, run_no) AS rn, count(*) OVER (PARTITION BY model) AS n FROM m2 WHERE cwe = 'all')
SELECT model, round(f_beta, 6) AS f_beta, round(f_beta - max(f_beta) OVER (), 6) AS delta FROM r WHERE rn = n // 2 + 1""")
def best_model(spark, sf):
    """Models compared by the score of their median run."""
    out = E.best_model(E.run_stability(_overall(spark, sf)).select("model", F.col("median_f").alias("f_beta")))
    return out.select("model", F.round("f_beta", 6).alias("f_beta"), F.round("delta", 6).alias("delta"))


@query(f"""{sql_with('eval_truth', 'eval_predictions')}, e AS (SELECT DISTINCT case_id, file, line FROM eval_truth), a AS (SELECT DISTINCT case_id, file, line FROM eval_predictions)
SELECT coalesce(e.case_id, a.case_id) AS case_id, coalesce(e.file, a.file) AS file, coalesce(e.line, a.line) AS line,
 CASE WHEN e.case_id IS NULL THEN 'unexpected' WHEN a.case_id IS NULL THEN 'missing' ELSE 'matched' END AS state
FROM e FULL JOIN a ON e.case_id = a.case_id AND e.file = a.file AND e.line = a.line""")
def location_match(spark, sf):
    return E.compare_locations(view(spark, sf, "eval_predictions"), view(spark, sf, "eval_truth"), ["case_id"])


_CASES = """specs AS (SELECT l.doc_id AS case_id, CASE WHEN min(l.quality) = 0 THEN 'found' ELSE 'not_found' END AS expect,
  CASE WHEN l.doc_id % 3 = 0 THEN 'HIGH' END AS severity, 'part ' || (l.doc_id % 12) AS kw1, 'TITLE ' || (l.doc_id % 5) AS kw2, l.doc_id % 4 AS n_kw FROM labels l GROUP BY l.doc_id),
f AS (SELECT ordinal2 AS case_id, severity, lower(evidence || ' ' || description || ' ' || title) AS txt FROM model_findings),
j AS (SELECT s.case_id, s.expect, s.severity, s.n_kw, count(f.case_id) AS n_findings,
  CASE WHEN s.severity IS NULL THEN true ELSE coalesce(bool_or(f.severity IN ('HIGH', 'CRITICAL')), false) END AS severity_ok,
  (n_kw = 0 OR coalesce(bool_or(contains(txt, kw1)), false)) AND (n_kw < 2 OR coalesce(bool_or(contains(txt, lower(kw2))), false)) AS evidence_ok
  FROM specs s LEFT JOIN f ON s.case_id = f.case_id GROUP BY s.case_id, s.expect, s.severity, s.n_kw, kw1, kw2),
st AS (SELECT *, CASE WHEN expect = 'found' THEN CASE WHEN n_findings > 0 AND evidence_ok THEN 'PASS' ELSE 'FAIL' END WHEN n_findings > 0 THEN 'FP' ELSE 'PASS' END AS status FROM j)"""


def _cases(spark, sf):
    c = F.col("case_id")
    kw1 = F.concat(F.lit("part "), (c % 12).cast("string"))
    kw2 = F.concat(F.lit("TITLE "), (c % 5).cast("string"))
    specs = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("case_id")).agg(
        F.when(F.min("quality") == 0, F.lit("found")).otherwise(F.lit("not_found")).alias("expect")
    ).select(
        "case_id", "expect", F.when(c % 3 == 0, F.lit("HIGH")).alias("severity"),
        F.when(c % 4 == 0, F.array().cast("array<string>")).when(c % 4 == 1, F.array(kw1)).otherwise(F.array(kw1, kw2)).alias("evidence_contains"))
    found = view(spark, sf, "model_findings").withColumn("case_id", F.col("ordinal2"))
    return E.case_status(E.evidence_matches(specs, found, ["case_id"]))


@query(f"""{sql_with('model_findings')}, {_CASES} SELECT case_id, expect, n_findings, severity_ok, evidence_ok FROM j""")
def evidence_match(spark, sf):
    return _cases(spark, sf).select("case_id", "expect", "n_findings", "severity_ok", "evidence_ok")


@query(f"""{sql_with('model_findings')}, {_CASES} SELECT case_id, status FROM st""")
def case_status(spark, sf):
    return _cases(spark, sf).select("case_id", "status")


@query(f"""{sql_with('model_findings')}, {_CASES}, a AS (SELECT case_id % 4 AS provider, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed,
 count(*) FILTER (status = 'FP') AS false_positives, count(*) AS total, count(*) FILTER (expect = 'found' AND status = 'PASS') AS tp FROM st GROUP BY ALL)
SELECT provider, passed, failed, false_positives, total, round(CASE WHEN tp + false_positives > 0 THEN tp / (tp + false_positives)::DOUBLE ELSE 1.0 END, 6) AS precision,
 round(CASE WHEN tp + failed > 0 THEN tp / (tp + failed)::DOUBLE ELSE 1.0 END, 6) AS recall FROM a""")
def status_summary(spark, sf):
    rows = _cases(spark, sf).withColumn("provider", F.col("case_id") % 4)
    return E.status_summary(rows, ["provider"]).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query(f"""{sql_with('model_findings')}, base AS (SELECT 'CWE-' || (20 + n_nationkey % 9) AS cwe, n_nationkey // 9 AS pos, 'm' || (n_nationkey % 20) || '/' AS file, 'part ' || (n_nationkey % 9) AS kw FROM nation),
h AS (SELECT b.cwe, b.pos, b.file, count(m.cwe) AS n, coalesce(bool_or(contains(lower(m.evidence || ' ' || m.description || ' ' || m.title), b.kw)), false) AS kw FROM base b LEFT JOIN model_findings m ON m.cwe = b.cwe AND contains(m.file, b.file) GROUP BY ALL),
t AS (SELECT cwe, count(*) AS n FROM model_findings WHERE cwe IS NOT NULL GROUP BY cwe),
r AS (SELECT cwe, min(pos) FILTER (n = 0 OR NOT kw) AS bad FROM h GROUP BY cwe)
SELECT r.cwe, coalesce(t.n, 0) AS n_findings, CASE WHEN coalesce(t.n, 0) < 100 THEN 'expected 100+ findings, got ' || coalesce(t.n, 0) WHEN h.n = 0 THEN 'no findings in ' || h.file
 WHEN NOT h.kw THEN 'evidence keywords not matched in ' || h.file END AS reason, (coalesce(t.n, 0) >= 100 AND bad IS NULL) AS passed
FROM r LEFT JOIN t USING (cwe) LEFT JOIN h ON h.cwe = r.cwe AND h.pos = r.bad""")
def baseline_expectation(spark, sf):
    p = F.col("n_nationkey")
    base = table(spark, sf, "nation").select(
        F.concat(F.lit("CWE-"), (20 + p % 9).cast("string")).alias("cwe"), F.lit(100).alias("min_findings"),
        F.floor(p / 9).cast("int").alias("pos"), F.concat(F.lit("m"), (p % 20).cast("string"), F.lit("/")).alias("file"),
        F.array(F.concat(F.lit("Part "), (p % 9).cast("string"))).alias("evidence_contains"))
    return E.baseline_expectations(base, view(spark, sf, "model_findings"))


_CELL = "CASE WHEN error IS NOT NULL THEN 'ERR' WHEN found >= expected_min THEN 'PASS' WHEN found > 0 THEN 'PART' ELSE 'FAIL' END"
_ONE = "one AS (SELECT cwe, provider, greatest(0, max(found) - CAST(cwe AS INT) % 4) AS found, min(expected_min) AS expected_min, CASE WHEN CAST(cwe AS INT) % 7 = 0 AND provider = 'prov1' THEN 'timeout' END AS error FROM check_results GROUP BY cwe, provider)"


def _one(spark, sf):
    r = view(spark, sf, "check_results").groupBy("cwe", "provider").agg(
        F.greatest(F.lit(0).cast("bigint"), F.max("found") - F.col("cwe").cast("int") % 4).alias("found"), F.min("expected_min").alias("expected_min"))
    return r.withColumn("error", F.when((F.col("cwe").cast("int") % 7 == 0) & (F.col("provider") == "prov1"), F.lit("timeout")))


@query(f"""{sql_with('check_results')}, {_ONE}, c AS (SELECT *, {_CELL} AS cell FROM one)
SELECT cwe, max(cell) FILTER (provider = 'prov0') AS prov0, max(cell) FILTER (provider = 'prov1') AS prov1, max(cell) FILTER (provider = 'prov2') AS prov2,
 CASE WHEN count(*) FILTER (cell = 'PASS') = 3 THEN 'all-pass' WHEN count(*) FILTER (cell = 'PASS') > 0 THEN 'partial' WHEN count(*) FILTER (cell = 'ERR') > 0 THEN 'err' ELSE 'fail' END AS state FROM c GROUP BY cwe""")
def pass_matrix(spark, sf):
    return E.pass_matrix(_one(spark, sf), ["prov0", "prov1", "prov2"])


@query(f"""{sql_with('check_results')} SELECT provider, count(*) FILTER (error IS NULL AND found >= expected_min) AS passes, count(*) FILTER (error IS NULL) AS total FROM check_results GROUP BY provider""")
def provider_scores(spark, sf):
    return E.provider_scores(view(spark, sf, "check_results"))


@query(f"""{sql_with('check_results')}, r AS (SELECT provider, cwe, avg(CASE WHEN error IS NULL AND found >= expected_min THEN 1.0 ELSE 0.0 END) FILTER (version = 'v1') AS a,
 avg(CASE WHEN error IS NULL AND found >= expected_min THEN 1.0 ELSE 0.0 END) FILTER (version = 'v2') AS b FROM check_results GROUP BY provider, cwe)
SELECT provider, cwe, round(a, 6) AS rate_old, round(b, 6) AS rate_new, round(b - a, 6) AS delta FROM r""")
def ab_delta(spark, sf):
    out = E.version_delta(view(spark, sf, "check_results"), "v1", "v2")
    return out.withColumns({c: F.round(c, 6) for c in ("rate_old", "rate_new", "delta")})


