"""Project quality: seven dimension scores and their composite, many projects in one job.

Percentiles, the Gini coefficient and means come from aggregations with a map-side step or from value
histograms, so a project of any size needs no single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintmark.functions import constants as K
from glintmark.functions.paths import is_scored_test_path, is_test_path
from glintmark.operators.graph import coupling
from glintmark.operators.prefix import gini, index_percentile


def sigmoid(x: Column, midpoint: float, k: float) -> Column:
    return F.lit(100.0) / (F.lit(1.0) + F.exp(F.lit(float(k)) * (x - F.lit(float(midpoint)))))


def exp_decay(count: Column, rate: float) -> Column:
    return F.lit(100.0) * F.exp(F.lit(-float(rate)) * count)


def inverse_linear(value: Column, good: float, bad: float) -> Column:
    """100 at ``good``, 0 at ``bad``, linear between."""
    if good == bad:
        return F.when(value <= good, F.lit(100.0)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) * (F.lit(float(bad)) - value) / (bad - good)))


def ratio_score(num: Column, den: Column) -> Column:
    """Share in percent between 0 and 100; 100 without a denominator."""
    return F.when(den <= 0, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), num / den * 100.0)))


_SUMS = [
    "total_callables", "documented_callables", "annotated_params", "total_params", "annotated_returns",
    "total_returns", "exception_handlers", "bare_excepts", "broad_excepts", "functions", "classes",
    "naming_violations", "public_definitions", "private_definitions", "null_forgiving_count", "lines",
]


def project_rollup(files: DataFrame, edges: DataFrame | None = None, components: DataFrame | None = None,
                   by: str = "project") -> DataFrame:
    """One row per project with every sum, mean, percentile and count the scores read.

    ``files`` holds file metrics (project, path, language, ...). ``edges`` (project, source, target) and
    ``components`` (project, component) of the reference graph are optional. Test files are told apart in
    two ways: line and file totals use one, the scores another.
    """
    path = F.col("path")
    test, source = is_test_path(path), ~is_scored_test_path(path)
    totals = files.groupBy(by).agg(
        F.count_if(test).alias("test_files"), F.count_if(~test).alias("source_files"),
        F.sum(F.when(test, F.col("lines")).otherwise(0)).alias("test_lines"),
        F.sum(F.when(~test, F.col("lines")).otherwise(0)).alias("source_lines"),
    )
    src = files.filter(source)
    sums = src.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_source"),
        *[F.sum(c).alias(f"s_{c}") for c in _SUMS],
        F.avg("functions").alias("avg_functions"), F.avg("lines").alias("avg_lines"),
        F.sum(F.size("unsafe_calls")).alias("n_unsafe"), F.count_if(F.size("unsafe_calls") > 0).alias("files_unsafe"),
        F.avg(F.when(F.col("max_nesting") > 0, F.col("max_nesting"))).alias("avg_nesting"),
        F.count_if("nullable_enabled").alias("files_nullable"),
    )
    languages = src.groupBy(by, "language").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("p"))
    main = languages.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("n"), "p", "language"))["language"].alias("main_language"))
    lengths = src.select(by, F.explode("function_lengths").alias("length"))
    mean_length = lengths.groupBy(by).agg(F.avg("length").alias("avg_length"))
    parts = [
        sums, main, mean_length,
        index_percentile(src, [by], "lines", 0.9, "p90_lines"),
        index_percentile(src, [by], "max_nesting", 0.9, "p90_nesting"),
        index_percentile(lengths, [by], "length", 0.9, "p90_length"),
        gini(src, [by], "lines", "lines_gini"),
    ]
    if edges is not None:
        c = coupling(edges, [by])
        parts.append(c.groupBy(by).agg(
            F.avg(F.col("ce") / (F.col("ce") + F.col("ca"))).alias("instability"), F.max("ce").alias("max_ce"),
            F.avg(F.when(F.col("ce") > 0, F.col("ce"))).alias("avg_ce"),
        ))
    if components is not None:
        parts.append(components.select(by, "component").distinct().groupBy(by).agg(F.count(F.lit(1)).alias("n_cycles")))
    out = reduce(lambda a, b: a.join(b, by, "left"), parts, totals)
    for name in ("instability", "max_ce", "avg_ce", "n_cycles"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("double"))
    return out


# Name of the score and of its part when a project has no source file or no graph.
_NEUTRAL = 50.0


def _dimension(name: str, score: Column, confidence: Column, subs: dict[str, Column], advice: list[Column]) -> Column:
    return F.struct(
        F.lit(name).alias("dim"), score.alias("score"), confidence.alias("confidence"),
        F.map_from_arrays(F.array(*[F.lit(k) for k in subs]), F.array(*[v.cast("double") for v in subs.values()])).alias("sub_scores"),
        F.array_compact(F.array(*advice) if advice else F.array().cast("array<string>")).alias("recommendations"),
    )


def _mix(weights: dict[str, float], subs: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, [subs[k] * F.lit(w) for k, w in weights.items()])


def _say(cond: Column, *parts: Column | str) -> Column:
    return F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _whole(c: Column) -> Column:
    return F.format_string("%.0f", c.cast("double"))


def dimension_scores(rollup: DataFrame, linter: DataFrame | None = None, complexity: DataFrame | None = None,
                     by: str = "project") -> DataFrame:
    """(project, dim, score, confidence, sub_scores, recommendations), seven rows per project.

    ``linter`` (project, weighted_per_kloc, high_severity, medium_severity) and ``complexity`` (project,
    avg_mi, avg_complexity, p90_complexity, simple_ratio) replace the weaker signals where a project has
    them.
    """
    r = rollup
    if linter is not None:
        r = r.join(linter.select(by, "weighted_per_kloc", "high_severity", "medium_severity"), by, "left")
    else:
        r = r.withColumns({c: F.lit(None).cast("double") for c in ("weighted_per_kloc", "high_severity", "medium_severity")})
    if complexity is not None:
        r = r.join(complexity.select(by, "avg_mi", "avg_complexity", "p90_complexity", "simple_ratio"), by, "left")
    else:
        r = r.withColumns({c: F.lit(None).cast("double") for c in ("avg_mi", "avg_complexity", "p90_complexity", "simple_ratio")})
    c = F.col
    zero = lambda x: F.coalesce(x, F.lit(0))
    has_source, has_graph = zero(c("n_source")) > 0, c("max_ce").isNotNull()
    has_linter, has_cc = c("weighted_per_kloc").isNotNull(), c("avg_complexity").isNotNull()
    sure, full, low = F.lit(1.0), F.lit(100.0), F.lit(0.3)
    p90_length = zero(c("p90_length"))

    def guarded(score: Column, known: Column) -> Column:
        return F.when(known, score).otherwise(F.lit(_NEUTRAL))

    doc = ratio_score(c("s_documented_callables"), c("s_total_callables"))
    length_p90 = F.when(c("p90_length").isNull(), full).otherwise(inverse_linear(c("p90_length"), 30, 100))
    m = {"doc_coverage": doc, "file_size_p90": inverse_linear(c("p90_lines"), 200, 800), "function_length_p90": length_p90,
         "radon_mi": F.least(full, F.greatest(F.lit(0.0), c("avg_mi"))),
         "cohesion": F.when(~has_cc, sigmoid(c("avg_functions"), 15, 0.2))}
    maintain = F.when(
        has_cc, _mix({"doc_coverage": 0.25, "file_size_p90": 0.20, "function_length_p90": 0.25, "radon_mi": 0.30}, m)
    ).otherwise(_mix({"doc_coverage": 0.30, "file_size_p90": 0.25, "function_length_p90": 0.25, "cohesion": 0.20}, m))
    maintain_say = [
        _say(has_cc & (c("avg_mi") < 40), "Average maintainability index is ", _whole(c("avg_mi"))),
        _say(doc < 50, "Documentation coverage is ", _whole(doc), "%"),
        _say(c("p90_lines") > 500, "P90 file size is ", c("p90_lines").cast("string"), " lines"),
        _say(p90_length > 50, "P90 function length is ", p90_length.cast("string"), " lines"),
    ]

    kloc = F.greatest(c("source_lines") / 1000.0, F.lit(0.1))
    s = {"ast_unsafe_patterns": exp_decay(c("n_unsafe") / kloc, 1.0),
         "ast_clean_file_ratio": ratio_score(c("n_source") - c("files_unsafe"), c("n_source")),
         "bandit_severity_density": exp_decay(c("weighted_per_kloc"), 0.3),
         "bandit_high_severity": exp_decay(c("high_severity"), 1.5),
         "bandit_medium_severity": exp_decay(c("medium_severity"), 0.5)}
    security = F.when(
        has_linter,
        _mix({"bandit_severity_density": 0.30, "bandit_high_severity": 0.25, "bandit_medium_severity": 0.15,
              "ast_unsafe_patterns": 0.15, "ast_clean_file_ratio": 0.15}, s),
    ).otherwise(_mix({"ast_unsafe_patterns": 0.60, "ast_clean_file_ratio": 0.40}, s))
    security_say = [
        _say(c("high_severity") > 0, _whole(c("high_severity")), " HIGH severity finding(s)"),
        _say(c("medium_severity") > 0, _whole(c("medium_severity")), " MEDIUM severity finding(s)"),
        _say(~has_linter, "Add linter results for deeper security analysis"),
    ]

    o = {"instability_balance": full * (F.lit(1.0) - F.abs(c("instability") - 0.5) * 2),
         "coupling_max_ce": sigmoid(c("max_ce"), 15, 0.3), "circular_deps": exp_decay(zero(c("n_cycles")), 1.0),
         "size_gini": (F.lit(1.0) - F.coalesce(c("lines_gini"), F.lit(0.0))) * 100.0}
    modular = _mix({"instability_balance": 0.25, "coupling_max_ce": 0.30, "circular_deps": 0.25, "size_gini": 0.20}, o)
    modular_say = [
        _say(c("max_ce") > 15, "Max efferent coupling is ", _whole(c("max_ce"))),
        _say(zero(c("n_cycles")) > 0, _whole(c("n_cycles")), " circular dependency(ies)"),
        _say(~has_graph, "Add a reference graph for accurate modularity scoring"),
    ]

    has_lines = c("source_lines") > 0
    ratio = F.when(has_lines, c("test_lines") / c("source_lines")).otherwise(F.lit(0.0))
    file_ratio = F.when(c("source_files") > 0, c("test_files") / c("source_files")).otherwise(F.lit(0.0))
    t = {"test_code_ratio": F.when(has_lines, sigmoid(F.abs(ratio - 1.0), 0.8, 3.0)).otherwise(F.lit(0.0)),
         "test_file_ratio": F.least(full, file_ratio * 100.0),
         "avg_nesting_depth": F.when(c("avg_nesting").isNull(), full).otherwise(sigmoid(c("avg_nesting"), 4, 1.0)),
         "radon_avg_complexity": sigmoid(c("avg_complexity"), 10, 0.3), "simple_function_ratio": c("simple_ratio") * 100.0,
         "avg_function_length": F.when(~has_cc, F.when(c("avg_length").isNull(), full).otherwise(sigmoid(c("avg_length"), 25, 0.15)))}
    testable = F.when(
        has_cc,
        _mix({"test_code_ratio": 0.30, "test_file_ratio": 0.15, "radon_avg_complexity": 0.25, "simple_function_ratio": 0.15,
              "avg_nesting_depth": 0.15}, t),
    ).otherwise(_mix({"test_code_ratio": 0.35, "test_file_ratio": 0.20, "avg_function_length": 0.25, "avg_nesting_depth": 0.20}, t))
    testable_say = [
        _say(ratio < 0.5, "Test-to-code ratio is ", F.format_string("%.2f", ratio.cast("double"))),
        _say(c("test_files") == 0, "No test files found"),
    ]

    bad = c("s_bare_excepts") + c("s_broad_excepts")
    python_types = ratio_score(c("s_annotated_params"), c("s_total_params")) * 0.55 + ratio_score(
        c("s_annotated_returns"), c("s_total_returns")) * 0.45
    source_kloc = F.greatest(c("s_lines") / 1000.0, F.lit(0.1))
    csharp_types = ratio_score(c("files_nullable"), c("n_source")) * 0.60 + exp_decay(
        c("s_null_forgiving_count") / source_kloc, 0.5) * 0.40
    csharp = c("main_language") == "csharp"
    types = F.when(csharp, csharp_types).otherwise(python_types)
    b = {"type_safety": types, "exception_handling_quality": F.when(
        c("s_exception_handlers") > 0, (F.lit(1.0) - bad / c("s_exception_handlers")) * 100.0).otherwise(full)}
    robust = _mix({"type_safety": 0.65, "exception_handling_quality": 0.35}, b)
    robust_say = [
        _say((types < 70) & csharp, "Enable #nullable across all files"),
        _say((types < 70) & ~F.coalesce(csharp, F.lit(False)), "Type coverage is ", _whole(types), "%"),
        _say(c("s_bare_excepts") > 0, c("s_bare_excepts").cast("string"), " bare/swallowed except(s)"),
    ]

    defs = c("s_functions") + c("s_classes")
    e = {"nesting_depth_p90": sigmoid(zero(c("p90_nesting")), 4, 1.5), "function_length_p90": length_p90,
         "naming_conventions": F.when(defs > 0, (F.lit(1.0) - c("s_naming_violations") / defs) * 100.0).otherwise(full),
         "radon_complexity_p90": sigmoid(c("p90_complexity"), 10, 0.4)}
    elegant = F.when(
        has_cc, _mix({k: 0.25 for k in ("nesting_depth_p90", "function_length_p90", "naming_conventions", "radon_complexity_p90")}, e)
    ).otherwise(_mix({"nesting_depth_p90": 0.35, "function_length_p90": 0.35, "naming_conventions": 0.30}, e))
    elegant_say = [
        _say(c("p90_nesting") > 4, "P90 nesting depth is ", c("p90_nesting").cast("string")),
        _say(p90_length > 50, "P90 function length is ", p90_length.cast("string"), " lines"),
    ]

    all_defs = c("s_public_definitions") + c("s_private_definitions")
    api = F.when(all_defs > 0, c("s_public_definitions") / all_defs)
    u = {"api_surface_ratio": F.when(api.isNull(), F.lit(_NEUTRAL)).when(api.between(0.3, 0.6), full)
         .when(api < 0.3, api / 0.3 * 100.0).otherwise(F.greatest(F.lit(0.0), F.lit(100.0) - (api - 0.6) / 0.4 * 100.0)),
         "coupling": F.when(c("avg_ce").isNull(), F.lit(_NEUTRAL)).otherwise(sigmoid(c("avg_ce"), 8, 0.4)),
         "module_size": sigmoid(c("avg_lines"), 200, 0.02)}
    reusable = _mix({"api_surface_ratio": 0.35, "coupling": 0.35, "module_size": 0.30}, u)
    reusable_say = [_say(api > 0.7, "API surface is ", _whole(api * 100.0), "% public")]

    by_source = F.when(has_source, sure).otherwise(low)
    rows = F.array(
        _dimension("maintainability", guarded(maintain, has_source), by_source, m, maintain_say),
        _dimension("security", guarded(security, has_source),
                   F.when(~has_source, low).when(has_linter, F.lit(0.9)).otherwise(F.lit(0.5)), s, security_say),
        _dimension("modularity", guarded(modular, has_graph), F.when(has_graph, sure).otherwise(low), o, modular_say),
        _dimension("testability", guarded(testable, has_source), by_source, t, testable_say),
        _dimension("robustness", guarded(robust, has_source), by_source, b, robust_say),
        _dimension("elegance", guarded(elegant, has_source), by_source, e, elegant_say),
        _dimension("reusability", guarded(reusable, has_source), by_source, u, reusable_say),
    )
    known = lambda v: v.isNotNull()
    return r.select(by, F.explode(rows).alias("d")).select(
        by, "d.dim", "d.score", "d.confidence",
        F.map_filter("d.sub_scores", lambda _, v: known(v)).alias("sub_scores"), "d.recommendations")


def quality_band(score: Column) -> Column:
    out = F.lit(K.QUALITY_BANDS[-1][0])
    for name, at in reversed(K.QUALITY_BANDS[:-1]):
        out = F.when(score >= at, F.lit(name)).otherwise(out)
    return out


def composite_index(scores: DataFrame, by: str = "project", profile: str = "production") -> DataFrame:
    """(project, composite, quality_band, floor_penalty), unrounded.

    Weighted geometric mean of the dimensions (at least 1, a missing one counts 50), lowered by up to 30 %
    for each dimension below the floor, capped at 100.
    """
    weights = K.WEIGHT_PROFILES.get(profile, K.WEIGHT_PROFILES["production"])
    floored = F.greatest(F.lit(1.0), F.col("score"))
    by_dim = [F.max(F.when(F.col("dim") == d, floored)).alias(f"_{d}") for d in K.DIMENSIONS]
    logs = reduce(lambda a, b: a + b, [
        F.lit(w) * F.log(F.coalesce(F.col(f"_{d}"), F.lit(50.0))) for d, w in zip(K.DIMENSIONS, weights)])
    deficit = lambda s: F.lit(1.0) - F.lit(0.3) * (K.QUALITY_FLOOR - s) / K.QUALITY_FLOOR
    factors = [F.when(F.col(f"_{d}") < K.QUALITY_FLOOR, deficit(F.col(f"_{d}"))).otherwise(F.lit(1.0)) for d in K.DIMENSIONS]
    penalty = F.greatest(F.lit(0.3), reduce(lambda a, b: a * b, factors))
    return (
        scores.groupBy(by).agg(*by_dim)
        .select(by, F.exp(logs).alias("_mean"), penalty.alias("floor_penalty"))
        .select(by, F.least(F.lit(100.0), F.col("_mean") * F.col("floor_penalty")).alias("composite"), "floor_penalty")
        .withColumn("quality_band", quality_band(F.col("composite")))
    )


def override_security(scores: DataFrame, counts: DataFrame, by: str = "project") -> DataFrame:
    """Replace the security score by one from review findings (project, urgent, elevated, total)."""
    subs = {"urgent_findings": exp_decay(F.col("urgent"), 1.5), "elevated_findings": exp_decay(F.col("elevated"), 0.5),
            "total_findings_volume": exp_decay(F.col("total"), 0.15)}
    score = _mix({"urgent_findings": 0.50, "elevated_findings": 0.25, "total_findings_volume": 0.25}, subs)
    say = [_say(F.col("urgent") > 0, F.col("urgent").cast("string"), " URGENT finding(s)"),
           _say(F.col("elevated") > 0, F.col("elevated").cast("string"), " ELEVATED finding(s)")]
    own = counts.select(by, _dimension("security", score, F.lit(1.0), subs, say).alias("d")).select(by, "d.*")
    kept = scores.join(own.select(by, "dim"), [by, "dim"], "left_anti")
    return kept.unionByName(own)
