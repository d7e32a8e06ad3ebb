"""Queries over project quality."""

from pyspark.sql import functions as F

from glintmark.operators import prefix, quality, reports
from glintmark.plans import project
from glintmark.plans.catalog.registry import query
from glintmark.plans.views import sql_with, table, view
from glintmark.session import settle
from glintmark.sources import scanners

_M = sql_with("file_metrics")
_SORTED = """sorted AS (SELECT project, lines, row_number() OVER (PARTITION BY project ORDER BY lines) AS i, count(*) OVER (PARTITION BY project) AS n FROM file_metrics)"""


@query(f"""{_M}, {_SORTED} SELECT project, lines AS p90 FROM sorted WHERE i = least(CAST(floor(n * 0.9::DOUBLE) AS BIGINT), n - 1) + 1""")
def p90(spark, sf):
    return prefix.index_percentile(view(spark, sf, "file_metrics"), ["project"], "lines", 0.9, "p90")


@query(f"""{_M}, {_SORTED} SELECT project, round(CASE WHEN max(n) < 2 THEN 0.0 ELSE sum((2 * i - n - 1) * lines)::DOUBLE / (max(n) * sum(lines)) END, 6) AS gini FROM sorted GROUP BY project""")
def gini(spark, sf):
    return prefix.gini(view(spark, sf, "file_metrics"), ["project"], "lines").select("project", F.round("gini", 6).alias("gini"))




def _metrics(spark, sf):
    """File metrics spread over the line items: project by brand-like key, counters from the numeric columns."""
    li = table(spark, sf, "lineitem")
    o, p, s, n = (F.col(f"l_{c}") for c in ("orderkey", "partkey", "suppkey", "linenumber"))
    i = lambda c: c.cast("bigint")
    return li.select(
        F.concat(F.lit("proj"), (s % 7).cast("string")).alias("project"),
        F.concat(F.when(n % 7 == 1, F.lit("tests/t")).otherwise(F.lit("src/a")), p.cast("string"), F.lit(".py")).alias("path"),
        F.when(p % 5 == 0, F.lit("csharp")).otherwise(F.lit("python")).alias("language"),
        i(10 + o % 400).alias("lines"), i(p % 9).alias("functions"), i(p % 3).alias("classes"),
        i(o % 6).alias("total_callables"), i(F.least(o % 6, p % 4)).alias("documented_callables"),
        i(p % 8).alias("total_params"), i(F.least(p % 8, o % 5)).alias("annotated_params"),
        i(p % 6).alias("total_returns"), i(F.least(p % 6, o % 4)).alias("annotated_returns"),
        i(o % 4).alias("exception_handlers"), i(F.when(o % 4 > 0, p % 2).otherwise(0)).alias("bare_excepts"), F.lit(0).cast("bigint").alias("broad_excepts"),
        i(o % 7).alias("max_nesting"), i(F.when(p % 9 > 0, o % 2).otherwise(0)).alias("naming_violations"),
        i(p % 7).alias("public_definitions"), i(o % 5).alias("private_definitions"), i(p % 2).alias("null_forgiving_count"),
        (o % 2 == 0).alias("nullable_enabled"),
        F.when(o % 3 == 0, F.array(i(p % 90), i(o % 60))).otherwise(F.array(i(p % 40))).alias("function_lengths"),
        F.when(o % 97 == 0, F.array(F.lit("line 1: eval"))).otherwise(F.array().cast("array<string>")).alias("unsafe_calls"),
    )


_METRICS = """fm AS (SELECT 'proj' || (l_suppkey % 7) AS project, CASE WHEN l_linenumber % 7 = 1 THEN 'tests/t' ELSE 'src/a' END || l_partkey || '.py' AS path, CASE WHEN l_partkey % 5 = 0 THEN 'csharp' ELSE 'python' END AS language,
 10 + l_orderkey % 400 AS lines, l_partkey % 9 AS functions, l_partkey % 3 AS classes, l_orderkey % 6 AS total_callables, least(l_orderkey % 6, l_partkey % 4) AS documented_callables,
 l_partkey % 8 AS total_params, least(l_partkey % 8, l_orderkey % 5) AS annotated_params, l_partkey % 6 AS total_returns, least(l_partkey % 6, l_orderkey % 4) AS annotated_returns,
 l_orderkey % 4 AS handlers, CASE WHEN l_orderkey % 4 > 0 THEN l_partkey % 2 ELSE 0 END AS bare, l_orderkey % 7 AS nesting, CASE WHEN l_partkey % 9 > 0 THEN l_orderkey % 2 ELSE 0 END AS naming,
 l_partkey % 7 AS pub, l_orderkey % 5 AS priv, CASE WHEN l_orderkey % 3 = 0 THEN [l_partkey % 90, l_orderkey % 60] ELSE [l_partkey % 40] END AS lens, CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE 0 END AS unsafe FROM lineitem),
sf AS (SELECT * FROM fm WHERE path LIKE 'src%'), tot AS (SELECT project, sum(CASE WHEN path LIKE 'tests%' THEN lines ELSE 0 END)::DOUBLE AS test_lines, sum(CASE WHEN path LIKE 'src%' THEN lines ELSE 0 END)::DOUBLE AS source_lines,
 count(*) FILTER (path LIKE 'tests%') AS test_files, count(*) FILTER (path LIKE 'src%') AS source_files FROM fm GROUP BY project),
s AS (SELECT project, count(*) AS n, sum(total_callables)::DOUBLE AS tc, sum(documented_callables)::DOUBLE AS dc, sum(total_params)::DOUBLE AS tp, sum(annotated_params)::DOUBLE AS ap, sum(total_returns)::DOUBLE AS tr, sum(annotated_returns)::DOUBLE AS ar,
 sum(handlers)::DOUBLE AS h, sum(bare)::DOUBLE AS b, sum(functions + classes)::DOUBLE AS defs, sum(naming)::DOUBLE AS nv, sum(pub)::DOUBLE AS pub, sum(priv)::DOUBLE AS priv, avg(functions) AS af, avg(lines) AS al, sum(unsafe)::DOUBLE AS un, count(*) FILTER (unsafe > 0) AS fu,
 avg(nesting) FILTER (nesting > 0) AS an, list_sort(list(lines)) AS ll, list_sort(list(nesting)) AS ln FROM sf GROUP BY project),
ls AS (SELECT project, unnest(lens) AS len FROM sf), l AS (SELECT project, avg(len) AS alen, list_sort(list(len)) AS lens FROM ls GROUP BY project),
g AS (SELECT project, sum((2 * i - n - 1) * lines)::DOUBLE / (max(n) * sum(lines)) AS gini FROM (SELECT project, lines, row_number() OVER (PARTITION BY project ORDER BY lines) AS i, count(*) OVER (PARTITION BY project) AS n FROM sf) GROUP BY project),
ed AS (SELECT DISTINCT 'proj' || (l_suppkey % 7) AS project, 'm' || (l_partkey % 60) AS source, 'm' || (l_partkey % 60 + 1 + l_orderkey % 9) AS target FROM lineitem),
ends AS (SELECT project, node, sum(o) AS ce, sum(i) AS ca FROM (SELECT project, source AS node, 1 AS o, 0 AS i FROM ed UNION ALL SELECT project, target, 0, 1 FROM ed) GROUP BY project, node),
c AS (SELECT project, avg(ce::DOUBLE / (ce + ca)) AS inst, max(ce) AS mce, avg(ce) FILTER (ce > 0) AS ace FROM ends GROUP BY project),
a AS (SELECT *, ll[least(CAST(floor(n * 0.9::DOUBLE) AS BIGINT), n - 1) + 1] AS p90l, ln[least(CAST(floor(n * 0.9::DOUBLE) AS BIGINT), n - 1) + 1] AS p90n, lens[least(CAST(floor(len(lens) * 0.9::DOUBLE) AS BIGINT), len(lens) - 1) + 1] AS p90f
 FROM tot JOIN s USING (project) JOIN l USING (project) JOIN g USING (project) JOIN c USING (project)),
ds AS (SELECT project, unnest([
 {'dim': 'maintainability', 'score': least(100, dc / tc * 100) * 0.30 + greatest(0, least(100, 100.0 * (800 - p90l) / 600)) * 0.25 + greatest(0, least(100, 100.0 * (100 - p90f) / 70)) * 0.25 + 100 / (1 + exp(0.2::DOUBLE * (af - 15))) * 0.20},
 {'dim': 'security', 'score': 100 * exp(-un / greatest(source_lines / 1000, 0.1)) * 0.60 + (n - fu)::DOUBLE / n * 100 * 0.40},
 {'dim': 'modularity', 'score': 100 * (1 - abs(inst - 0.5) * 2) * 0.25 + 100 / (1 + exp(0.3::DOUBLE * (mce - 15))) * 0.30 + 100 * 0.25 + (1 - gini) * 100 * 0.20},
 {'dim': 'testability', 'score': 100 / (1 + exp(3::DOUBLE * (abs(test_lines / source_lines - 1) - 0.8))) * 0.35 + least(100, test_files::DOUBLE / source_files * 100) * 0.20 + 100 / (1 + exp(0.15::DOUBLE * (alen - 25))) * 0.25 + 100 / (1 + exp(1::DOUBLE * (an - 4))) * 0.20},
 {'dim': 'robustness', 'score': (ap / tp * 100 * 0.55 + ar / tr * 100 * 0.45) * 0.65 + (1 - b / h) * 100 * 0.35},
 {'dim': 'elegance', 'score': 100 / (1 + exp(1.5::DOUBLE * (p90n - 4))) * 0.35 + greatest(0, least(100, 100.0 * (100 - p90f) / 70)) * 0.35 + (1 - nv / defs) * 100 * 0.30},
 {'dim': 'reusability', 'score': (CASE WHEN pub / (pub + priv) BETWEEN 0.3 AND 0.6 THEN 100 WHEN pub / (pub + priv) < 0.3 THEN pub / (pub + priv) / 0.3 * 100 ELSE greatest(0, 100 - (pub / (pub + priv) - 0.6) / 0.4 * 100) END)::DOUBLE * 0.35 + 100 / (1 + exp(0.4::DOUBLE * (ace - 8))) * 0.35 + 100 / (1 + exp(0.02::DOUBLE * (al - 200))) * 0.30}], recursive := true) FROM a)"""


def _project_edges(spark, sf):
    li = table(spark, sf, "lineitem")
    m = F.col("l_partkey") % 60
    return li.select(
        F.concat(F.lit("proj"), (F.col("l_suppkey") % 7).cast("string")).alias("project"), F.concat(F.lit("m"), m.cast("string")).alias("source"),
        F.concat(F.lit("m"), (m + 1 + F.col("l_orderkey") % 9).cast("string")).alias("target")).distinct()


def _scores(spark, sf):
    return quality.dimension_scores(quality.project_rollup(_metrics(spark, sf), _project_edges(spark, sf)))


@query(f"""WITH {_METRICS} SELECT project, dim, round(score, 6) AS score FROM ds""")
def dimension_scores(spark, sf):
    return _scores(spark, sf).select("project", "dim", F.round("score", 6).alias("score"))


# Every branch of the scores in some project: linter counts for even projects, complexity for every third, cycles for odd ones, one project in C#.
_BRANCHES = """x AS (SELECT 'proj' || (l_suppkey % 7) AS project, l_suppkey % 7 AS k, l_orderkey AS o, l_partkey AS p FROM lineitem),
lint AS (SELECT project, count(*) FILTER (o % 211 = 0) / 8.0::DOUBLE AS wk, count(*) FILTER (o % 1999 = 0) AS hi, count(*) FILTER (o % 997 = 0) AS med FROM x WHERE k % 2 = 0 GROUP BY project),
cc AS (SELECT project, avg(30 + p % 90) AS mi, avg(o % 20)::DOUBLE AS ac, max(o % 17) AS p90c, avg(CASE WHEN o % 3 = 0 THEN 1 ELSE 0 END) AS simple FROM x WHERE k % 3 = 0 GROUP BY project),
cyc AS (SELECT project, count(DISTINCT p % 3) AS cycles FROM x WHERE k % 2 = 1 GROUP BY project),
extra AS (SELECT 'proj' || (l_suppkey % 7) AS project, sum(l_partkey % 2)::DOUBLE AS forgiving, count(*) FILTER (l_orderkey % 2 = 0) AS nullable, sum(10 + l_orderkey % 400) AS slines FROM lineitem WHERE l_linenumber % 7 <> 1 GROUP BY 1),
v AS (SELECT *, ac IS NOT NULL AS has_cc, wk IS NOT NULL AS has_lint, project = 'proj3' AS cs FROM a LEFT JOIN lint USING (project) LEFT JOIN cc USING (project) LEFT JOIN cyc USING (project) JOIN extra USING (project)),
w AS (SELECT *, least(100, dc / tc * 100)::DOUBLE AS doc, greatest(0, least(100, 100.0 * (100 - p90f) / 70))::DOUBLE AS flen, pub / (pub + priv) AS api, abs(test_lines / source_lines - 1) AS off FROM v),
parts AS (SELECT project, unnest([
 {'dim': 'maintainability', 'part': 'doc_coverage', 'weight': CASE WHEN has_cc THEN 0.25 ELSE 0.30 END, 'value': doc},
 {'dim': 'maintainability', 'part': 'file_size_p90', 'weight': CASE WHEN has_cc THEN 0.20 ELSE 0.25 END, 'value': greatest(0, least(100, 100.0 * (800 - p90l) / 600))::DOUBLE},
 {'dim': 'maintainability', 'part': 'function_length_p90', 'weight': 0.25, 'value': flen},
 {'dim': 'maintainability', 'part': 'radon_mi', 'weight': 0.30, 'value': least(100, greatest(0, mi))::DOUBLE},
 {'dim': 'maintainability', 'part': 'cohesion', 'weight': 0.20, 'value': CASE WHEN NOT has_cc THEN 100 / (1 + exp(0.2::DOUBLE * (af - 15))) END},
 {'dim': 'security', 'part': 'ast_unsafe_patterns', 'weight': CASE WHEN has_lint THEN 0.15 ELSE 0.60 END, 'value': 100 * exp(-un / greatest(source_lines / 1000, 0.1))},
 {'dim': 'security', 'part': 'ast_clean_file_ratio', 'weight': CASE WHEN has_lint THEN 0.15 ELSE 0.40 END, 'value': (n - fu)::DOUBLE / n * 100},
 {'dim': 'security', 'part': 'bandit_severity_density', 'weight': 0.30, 'value': 100 * exp(-0.3::DOUBLE * wk)},
 {'dim': 'security', 'part': 'bandit_high_severity', 'weight': 0.25, 'value': 100 * exp(-1.5::DOUBLE * hi)},
 {'dim': 'security', 'part': 'bandit_medium_severity', 'weight': 0.15, 'value': 100 * exp(-0.5::DOUBLE * med)},
 {'dim': 'modularity', 'part': 'instability_balance', 'weight': 0.25, 'value': 100 * (1 - abs(inst - 0.5) * 2)},
 {'dim': 'modularity', 'part': 'coupling_max_ce', 'weight': 0.30, 'value': 100 / (1 + exp(0.3::DOUBLE * (mce - 15)))},
 {'dim': 'modularity', 'part': 'circular_deps', 'weight': 0.25, 'value': 100 * exp(-coalesce(cycles, 0)::DOUBLE)},
 {'dim': 'modularity', 'part': 'size_gini', 'weight': 0.20, 'value': (1 - gini) * 100},
 {'dim': 'testability', 'part': 'test_code_ratio', 'weight': CASE WHEN has_cc THEN 0.30 ELSE 0.35 END, 'value': 100 / (1 + exp(3::DOUBLE * (off - 0.8)))},
 {'dim': 'testability', 'part': 'test_file_ratio', 'weight': CASE WHEN has_cc THEN 0.15 ELSE 0.20 END, 'value': least(100, test_files::DOUBLE / source_files * 100)::DOUBLE},
 {'dim': 'testability', 'part': 'avg_nesting_depth', 'weight': CASE WHEN has_cc THEN 0.15 ELSE 0.20 END, 'value': 100 / (1 + exp(1::DOUBLE * (an - 4)))},
 {'dim': 'testability', 'part': 'radon_avg_complexity', 'weight': 0.25, 'value': 100 / (1 + exp(0.3::DOUBLE * (ac - 10)))},
 {'dim': 'testability', 'part': 'simple_function_ratio', 'weight': 0.15, 'value': simple * 100},
 {'dim': 'testability', 'part': 'avg_function_length', 'weight': 0.25, 'value': CASE WHEN NOT has_cc THEN 100 / (1 + exp(0.15::DOUBLE * (alen - 25))) END},
 {'dim': 'robustness', 'part': 'type_safety', 'weight': 0.65, 'value': CASE WHEN cs THEN nullable::DOUBLE / n * 100 * 0.60 + 100 * exp(-0.5::DOUBLE * forgiving / greatest(slines / 1000.0::DOUBLE, 0.1)) * 0.40 ELSE ap / tp * 100 * 0.55 + ar / tr * 100 * 0.45 END},
 {'dim': 'robustness', 'part': 'exception_handling_quality', 'weight': 0.35, 'value': (1 - b / h) * 100},
 {'dim': 'elegance', 'part': 'nesting_depth_p90', 'weight': CASE WHEN has_cc THEN 0.25 ELSE 0.35 END, 'value': 100 / (1 + exp(1.5::DOUBLE * (p90n - 4)))},
 {'dim': 'elegance', 'part': 'function_length_p90', 'weight': CASE WHEN has_cc THEN 0.25 ELSE 0.35 END, 'value': flen},
 {'dim': 'elegance', 'part': 'naming_conventions', 'weight': CASE WHEN has_cc THEN 0.25 ELSE 0.30 END, 'value': (1 - nv / defs) * 100},
 {'dim': 'elegance', 'part': 'radon_complexity_p90', 'weight': 0.25, 'value': 100 / (1 + exp(0.4::DOUBLE * (p90c - 10)))},
 {'dim': 'reusability', 'part': 'api_surface_ratio', 'weight': 0.35, 'value': CASE WHEN api BETWEEN 0.3 AND 0.6 THEN 100 WHEN api < 0.3 THEN api / 0.3 * 100 ELSE greatest(0, 100 - (api - 0.6) / 0.4 * 100) END::DOUBLE},
 {'dim': 'reusability', 'part': 'coupling', 'weight': 0.35, 'value': 100 / (1 + exp(0.4::DOUBLE * (ace - 8)))},
 {'dim': 'reusability', 'part': 'module_size', 'weight': 0.30, 'value': 100 / (1 + exp(0.02::DOUBLE * (al - 200)))}], recursive := true) FROM w)"""


def _branch_scores(spark, sf):
    li = table(spark, sf, "lineitem")
    k, o, p = F.col("l_suppkey") % 7, F.col("l_orderkey"), F.col("l_partkey")
    project = F.concat(F.lit("proj"), k.cast("string")).alias("project")
    files = _metrics(spark, sf).withColumn("language", F.when(F.col("project") == "proj3", "csharp").otherwise(F.lit("python")))
    linter = li.filter(k % 2 == 0).groupBy(project).agg(
        (F.count_if(o % 211 == 0) / 8.0).alias("weighted_per_kloc"), F.count_if(o % 1999 == 0).alias("high_severity"), F.count_if(o % 997 == 0).alias("medium_severity"))
    complexity = li.filter(k % 3 == 0).groupBy(project).agg(
        F.avg(30 + p % 90).alias("avg_mi"), F.avg(o % 20).alias("avg_complexity"), F.max(o % 17).alias("p90_complexity"), F.avg(F.when(o % 3 == 0, 1).otherwise(0)).alias("simple_ratio"))
    components = li.filter(k % 2 == 1).select(project, (p % 3).cast("string").alias("component")).distinct()
    return quality.dimension_scores(quality.project_rollup(files, _project_edges(spark, sf), components), linter, complexity)


@query(f"""WITH {_METRICS}, {_BRANCHES}, d AS (SELECT project, dim, sum(weight * value) AS score FROM parts WHERE value IS NOT NULL GROUP BY project, dim)
SELECT project, dim, part, round(value, 6) AS value, round(score, 6) AS score, CAST(CASE WHEN dim <> 'security' THEN 1 WHEN project IN (SELECT project FROM lint) THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence
FROM parts JOIN d USING (project, dim) WHERE value IS NOT NULL""")
def score_parts(spark, sf):
    """Every part of every score with linter, complexity, C# and cycle branches."""
    s = _branch_scores(spark, sf).select("project", "dim", "score", "confidence", F.explode("sub_scores").alias("part", "value"))
    return s.select("project", "dim", "part", F.round("value", 6).alias("value"), F.round("score", 6).alias("score"), "confidence")


@query(f"""WITH {_METRICS}, {_BRANCHES}, said AS (SELECT project, unnest([
 {{'dim': 'maintainability', 'n': CASE WHEN has_cc AND mi < 40 THEN 1 ELSE 0 END + CASE WHEN doc < 50 THEN 1 ELSE 0 END + CASE WHEN p90l > 500 THEN 1 ELSE 0 END + CASE WHEN p90f > 50 THEN 1 ELSE 0 END}},
 {{'dim': 'security', 'n': CASE WHEN hi > 0 THEN 1 ELSE 0 END + CASE WHEN med > 0 THEN 1 ELSE 0 END + CASE WHEN has_lint THEN 0 ELSE 1 END}},
 {{'dim': 'modularity', 'n': CASE WHEN mce > 15 THEN 1 ELSE 0 END + CASE WHEN cycles > 0 THEN 1 ELSE 0 END}},
 {{'dim': 'testability', 'n': CASE WHEN test_lines / source_lines < 0.5 THEN 1 ELSE 0 END + CASE WHEN test_files = 0 THEN 1 ELSE 0 END}},
 {{'dim': 'robustness', 'n': CASE WHEN (SELECT value FROM parts q WHERE q.project = w.project AND q.part = 'type_safety') < 70 THEN 1 ELSE 0 END + CASE WHEN b > 0 THEN 1 ELSE 0 END}},
 {{'dim': 'elegance', 'n': CASE WHEN p90n > 4 THEN 1 ELSE 0 END + CASE WHEN p90f > 50 THEN 1 ELSE 0 END}},
 {{'dim': 'reusability', 'n': CASE WHEN api > 0.7 THEN 1 ELSE 0 END}}], recursive := true) FROM w)
SELECT project, dim, CAST(n AS INT) AS n_recommendations FROM said""")
def score_advice(spark, sf):
    """How many recommendations each dimension gives, in the same branches."""
    return _branch_scores(spark, sf).select("project", "dim", F.size("recommendations").alias("n_recommendations"))


def _composite_sql(source: str) -> str:
    weights = {"maintainability": 0.2, "security": 0.15, "modularity": 0.15, "testability": 0.15, "robustness": 0.13, "elegance": 0.12, "reusability": 0.1}  # fixed values of the profile, written out
    ln = " + ".join(f"{w} * ln(max(greatest(1, score)) FILTER (dim = '{d}'))" for d, w in weights.items())
    pen = " * ".join(f"(CASE WHEN max(greatest(1, score)) FILTER (dim = '{d}') < 20 THEN 1 - 0.3::DOUBLE * (20 - max(greatest(1, score)) FILTER (dim = '{d}')) / 20 ELSE 1 END)" for d in weights)
    return f"""q AS (SELECT project, exp({ln}) AS gm, greatest(0.3::DOUBLE, {pen}) AS pen FROM {source} GROUP BY project),
q2 AS (SELECT project, least(100, gm * pen) AS c, pen FROM q)
SELECT project, round(c, 6) AS composite, round(pen, 6) AS floor_penalty, CASE WHEN c >= 80 THEN 'Excellent' WHEN c >= 65 THEN 'Good' WHEN c >= 55 THEN 'Adequate' WHEN c >= 31 THEN 'Acceptable' ELSE 'Poor' END AS quality_band FROM q2"""


def _rounded(df):
    return df.select("project", F.round("composite", 6).alias("composite"), F.round("floor_penalty", 6).alias("floor_penalty"), "quality_band")


@query(f"""WITH {_METRICS}, {_composite_sql('ds')}""")
def quality_index(spark, sf):
    return _rounded(quality.composite_index(_scores(spark, sf)))


@query(f"""WITH {_METRICS}, rc AS (SELECT 'proj' || (o_custkey % 7) AS project, count(*) FILTER (o_orderkey % 900 = 0) AS u, count(*) FILTER (o_orderkey % 700 = 1) AS e, count(*) FILTER (o_orderkey % 800 < 2) AS t FROM orders GROUP BY 1),
ov AS (SELECT project, dim, score FROM ds WHERE dim <> 'security' UNION ALL SELECT project, 'security', 100 * exp(-1.5::DOUBLE * u) * 0.5 + 100 * exp(-0.5::DOUBLE * e) * 0.25 + 100 * exp(-0.15::DOUBLE * t) * 0.25 FROM rc), {_composite_sql('ov')}""")
def override_score(spark, sf):
    k = F.col("o_orderkey")
    counts = table(spark, sf, "orders").groupBy(F.concat(F.lit("proj"), (F.col("o_custkey") % 7).cast("string")).alias("project")).agg(
        F.count_if(k % 900 == 0).alias("urgent"), F.count_if(k % 700 == 1).alias("elevated"), F.count_if(k % 800 < 2).alias("total"))
    return _rounded(quality.composite_index(quality.override_security(_scores(spark, sf), counts)))


@query(f"""WITH {_METRICS}, {_composite_sql('ds').replace('SELECT project, round(c, 6)', ', out AS (SELECT project, round(c, 6)')})
SELECT project, round(composite, 1) AS composite, quality_band, floor_penalty, round(max(score) FILTER (dim = 'security'), 1) AS security FROM out JOIN ds USING (project) GROUP BY ALL""")
def score_export(spark, sf):
    """Quality results as JSON per project, read back."""
    scores = settle(_scores(spark, sf), "scores")
    docs = reports.score_json(scores, quality.composite_index(scores), "project")
    kind = "struct<composite:double,quality_band:string,floor_penalty:double,dimensions:map<string,struct<score:double>>>"
    d = docs.select("project", F.from_json("value", kind).alias("d"))
    return d.select("project", "d.composite", "d.quality_band", "d.floor_penalty", F.col("d.dimensions")["security"]["score"].alias("security"))


def _linter_texts(spark, sf):
    """Linter reports as JSON, one per order, made of the findings."""
    f = view(spark, sf, "findings")
    noise = F.when(F.col("rule_id") == "R1", F.lit("B101")).otherwise(F.col("rule_id"))
    name = F.when(F.col("line") % 3 == 0, F.concat(F.lit("tests/"), "file")).otherwise(F.col("file"))
    sev = F.when(F.col("level") == "error", "HIGH").when(F.col("level") == "warning", "MEDIUM").when(F.col("level") == "note", "LOW").otherwise("UNDEFINED")
    row = F.struct(noise.alias("test_id"), sev.alias("issue_severity"), F.lit("LOW").alias("issue_confidence"), F.col("message").alias("issue_text"),
                   name.alias("filename"), F.col("line").alias("line_number"))
    loc = F.map_from_arrays(F.array(F.lit("a.py"), F.lit("b.py")), F.array(F.struct(F.lit(700).alias("loc")), F.struct((F.col("_k") % 5 * 100).alias("loc"))))
    return f.groupBy(F.floor(F.col("ordinal") / 8000000).alias("_k")).agg(F.collect_list(row).alias("results")).select(
        F.concat(F.lit("run"), (F.col("_k") % 40).cast("string")).alias("doc"), F.to_json(F.struct("results", loc.alias("metrics"))).alias("value"))


@query(f"""{sql_with('findings')}, r AS (SELECT ordinal // 8000000 AS k, 'run' || (ordinal // 8000000 % 40) AS doc, level FROM findings),
r2 AS (SELECT 'run' || (ordinal // 8000000 % 40) AS doc, level FROM findings WHERE NOT (rule_id = 'R1' AND line % 3 = 0)),
loc AS (SELECT doc, CAST(sum(700 + k % 5 * 100) AS BIGINT) AS total_loc FROM (SELECT DISTINCT k, doc FROM r) GROUP BY doc),
c AS (SELECT doc, count(*) AS n, count(*) FILTER (level = 'error') AS h, count(*) FILTER (level = 'warning') AS m, count(*) FILTER (level = 'note') AS l FROM r2 GROUP BY doc)
SELECT doc, n AS total_findings, h AS high_severity, m AS medium_severity, l AS low_severity, h * 3 + m * 2 + l AS weighted_findings, round((h * 3 + m * 2 + l) / greatest(total_loc / 1000.0::DOUBLE, 0.1), 6) AS weighted_per_kloc, total_loc
FROM loc JOIN c USING (doc)""")
def linter_density(spark, sf):
    return scanners.linter_metrics(_linter_texts(spark, sf)).withColumn("weighted_per_kloc", F.round("weighted_per_kloc", 6))


def _complexity_texts(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size")
    rank = F.when(size <= 5, "A").when(size <= 10, "B").when(size <= 20, "C").when(size <= 30, "D").when(size <= 40, "E").otherwise("F")
    fn = F.struct(F.lit("function").alias("type"), F.col("p_name").alias("name"), size.alias("complexity"), rank.alias("rank"), F.lit(1).alias("lineno"))
    files = p.groupBy("p_brand", F.floor(F.col("p_partkey") / 20).alias("_f")).agg(F.collect_list(fn).alias("fs"))
    return files.select(F.col("p_brand").alias("doc"), F.to_json(F.create_map(F.concat(F.lit("f"), F.col("_f").cast("string")), "fs")).alias("value"))


@query("""WITH s AS (SELECT p_brand AS doc, p_size AS c, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT doc, max(n) AS total_functions, round(avg(c), 6) AS avg_complexity, max(c) AS max_complexity, max(c) FILTER (i = least(CAST(floor(n * 0.9::DOUBLE) AS BIGINT), n - 1) + 1) AS p90_complexity,
 count(*) FILTER (c > 40) AS "rank_F", round(count(*) FILTER (c <= 10) / max(n)::DOUBLE, 6) AS simple_ratio FROM s GROUP BY doc""")
def complexity_profile(spark, sf):
    m = scanners.complexity_metrics(scanners.complexity_rows(_complexity_texts(spark, sf)))
    return m.select("doc", "total_functions", F.round("avg_complexity", 6).alias("avg_complexity"), "max_complexity", "p90_complexity", "rank_F",
                    F.round("simple_ratio", 6).alias("simple_ratio"))


@query("""SELECT p_brand AS doc, 'CC:' || CASE WHEN p_size <= 20 THEN 'C' WHEN p_size <= 30 THEN 'D' WHEN p_size <= 40 THEN 'E' ELSE 'F' END AS rule_id, CASE WHEN p_size > 30 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
 'function ''' || p_name || ''' has CC ' || p_size || ' (rank ' || CASE WHEN p_size <= 20 THEN 'C' WHEN p_size <= 30 THEN 'D' WHEN p_size <= 40 THEN 'E' ELSE 'F' END || ')' AS message, 'f' || (p_partkey // 20) AS file, 1 AS line FROM part WHERE p_size > 10""")
def complexity_findings(spark, sf):
    return scanners.complexity_findings(scanners.complexity_rows(_complexity_texts(spark, sf)))


@query("""SELECT p_brand AS doc, round(avg(p_retailprice / 100), 6) AS avg_mi, round(min(p_retailprice / 100), 6) AS min_mi FROM part GROUP BY p_brand""")
def maintainability_index(spark, sf):
    t = table(spark, sf, "part").select(
        F.col("p_brand").alias("doc"),
        F.to_json(F.create_map(F.concat(F.lit("f"), F.col("p_partkey").cast("string")), F.struct((F.col("p_retailprice") / 100).alias("mi")))).alias("value"))
    m = scanners.maintainability_metrics(t)
    return m.select("doc", F.round("avg_mi", 6).alias("avg_mi"), F.round("min_mi", 6).alias("min_mi"))


@query()
def source_quality(spark, sf):
    """Whole quality plan over Python sources: analyse, link, find cycles and score each project in one job."""
    scores, _ = project.score_files(view(spark, sf, "python_sources").select("project", "path", "text"))
    return scores.select("project", "dim", F.round("score", 4).alias("score"))
