"""Measure detectors against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintmark.functions.levels import severity_at_least
from glintmark.session import dealt

_RUN = ["model", "run_no"]


def near_lines(places: DataFrame, tolerance: int = 1) -> DataFrame:
    """Every place once per line within the tolerance, in ``near``; turns the range join into an equi join."""
    return places.withColumn(
        "near", F.explode(F.sequence(F.col("line") - tolerance, F.col("line") + tolerance))
    )


def matched_truth(truth: DataFrame, found: DataFrame, by: list[str], tolerance: int = 1) -> DataFrame:
    """Truth rows with ``hit``: any found place of the same file within the tolerance.

    ``by`` are the columns both sides share besides the file.
    """
    keys = [*by, "file"]
    hits = (
        near_lines(truth.select(*keys, "line").distinct(), tolerance)
        .join(found.select(*keys, F.col("line").alias("near")).distinct(), [*keys, "near"], "left_semi")
        .select(*keys, "line").distinct().withColumn("_hit", F.lit(True))
    )
    return truth.join(hits, [*keys, "line"], "left").select(
        *truth.columns, F.coalesce("_hit", F.lit(False)).alias("hit")
    )


def confusion_rows(predictions: DataFrame, truth: DataFrame, evaluated: DataFrame) -> DataFrame:
    """(model, run_no, case_id, tp, fp, tn, fn) per evaluated case.

    ``evaluated`` has (model, run_no, case_id, has_patched): the cases a model really ran. Places on the
    vulnerable source count once each; every finding on the patched twin is a false positive. The predictions are counted,
    so that no task gets more of them than it can hold.
    """
    case, place = [*_RUN, "case_id"], ["case_id", "file", "line"]
    n = predictions.count()
    expected = truth.filter(F.col("label") == "true_positive").select("case_id", "file", "line").distinct()
    source = predictions.filter((F.col("variant") == "source") & (F.col("line") > 0) & (F.col("file") != ""))
    found = dealt(source.select(*case, "file", "line"), n, *place).distinct()
    # The truth of a case is the same for every model: it meets the found places per case, not per run.
    near = near_lines(expected.withColumn("_expected", F.col("line"))).select(
        "case_id", "file", "_expected", F.col("near").alias("line"))
    met = found.join(dealt(near, n, *place), place, "left")
    n_expected = expected.groupBy("case_id").agg(F.count(F.lit(1)).alias("expected"))
    hit = F.when(F.col("_expected").isNotNull(), F.struct("file", "_expected"))
    one = F.lit(1).cast("bigint")
    # Each side adds its own columns; a single aggregation per case then sums them.
    rows = (
        met.select(*case, hit.alias("hit"), one.alias("found"), F.col("_expected").isNull().cast("bigint").alias("stray"))
        .unionByName(predictions.filter(F.col("variant") == "patched").select(*case, one.alias("patched")), allowMissingColumns=True)
        .unionByName(evaluated.join(n_expected, "case_id", "left").select(*case, "has_patched", "expected"), allowMissingColumns=True)
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c)
    sums = dealt(rows, n, "case_id").groupBy(*case).agg(
        F.count_distinct("hit").alias("tp"), total("found"), total("stray"), total("expected"), total("patched"),
        F.max("has_patched").alias("has_patched"),
    ).filter(F.col("has_patched").isNotNull())
    twin = F.col("has_patched")
    return sums.select(
        *case, "tp", (F.col("stray") + F.when(twin, F.col("patched")).otherwise(0)).alias("fp"),
        (F.when(twin & (F.col("patched") == 0), one).otherwise(0)
         + F.when((F.col("expected") == 0) & (F.col("found") == 0), one).otherwise(0)).alias("tn"),
        (F.col("expected") - F.col("tp")).alias("fn"),
    )


def confusion_rollup(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """Counts per (model, run_no, cwe) and overall (cwe = 'all'), in one pass."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")]
    return (
        rows.join(cases.select("case_id", "cwe"), "case_id")
        .rollup(*_RUN, "cwe").agg(F.grouping_id().alias("_g"), *sums)
        .filter(F.col("_g").isin(0, 1))
        .select(*_RUN, F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col("cwe")).alias("cwe"),
                "tp", "fp", "tn", "fn")
    )


def _ratio(num: Column, den: Column, empty: float) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(empty))


def detection_metrics(counts: DataFrame, beta: float = 2.0, empty: float = 0.0) -> DataFrame:
    """Add precision, recall, f_beta, mcc and youden_j; ``empty`` is the value of a ratio without cases."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    p, r = F.col("precision"), F.col("recall")
    b2 = beta * beta
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return (
        counts.withColumn("precision", _ratio(tp, tp + fp, empty))
        .withColumn("recall", _ratio(tp, tp + fn, empty))
        .withColumn("f_beta", F.when(p + r == 0, F.lit(0.0)).otherwise((1 + b2) * p * r / (b2 * p + r)))
        .withColumn("mcc", _ratio(tp * tn - fp * fn, den, 0.0))
        .withColumn("youden_j", r + _ratio(tn, tn + fp, 0.0) - 1.0)
    )


def evidence_matches(cases: DataFrame, findings: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_findings, severity_ok, evidence_ok) per case.

    ``cases`` has (by, severity, evidence_contains). Every keyword must occur in some finding's evidence,
    description or title. The keywords travel with each finding, and only the distinct matched ones are
    aggregated. ``severity_ok`` is reported and decides nothing.
    """
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("evidence", "description", "title")]))
    joined = findings.join(cases.select(*by, F.col("severity").alias("_min"), F.col("evidence_contains").alias("_kw")), by)
    rows = joined.select(
        *by, F.coalesce(severity_at_least(F.col("severity"), F.col("_min")), F.lit(True)).alias("_sev"),
        F.filter("_kw", lambda k: F.contains(text, F.lower(k))).alias("_hit"),
    )
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_findings"), F.max("_sev").alias("severity_ok"))
    words = rows.select(*by, F.explode("_hit").alias("w")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_nw"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    wanted = F.size(F.array_distinct(F.coalesce("evidence_contains", F.array().cast("array<string>"))))
    return (
        cases.join(counts, by, "left").join(words, by, "left")
        .select(*cases.columns, zero("n_findings").alias("n_findings"),
                F.coalesce("severity_ok", F.col("severity").isNull()).alias("severity_ok"),
                (zero("_nw") == wanted).alias("evidence_ok"))
    )


def case_status(matched: DataFrame) -> DataFrame:
    """PASS, FAIL or FP per case from ``expect``, ``n_findings`` and ``evidence_ok``."""
    some = F.col("n_findings") > 0
    status = (
        F.when(F.col("expect") == "found",
               F.when(some & F.col("evidence_ok"), F.lit("PASS")).otherwise(F.lit("FAIL")))
        .otherwise(F.when(some, F.lit("FP")).otherwise(F.lit("PASS")))
    )
    return matched.withColumn("status", status)


def status_summary(statuses: DataFrame, by: list[str], empty: float = 1.0) -> DataFrame:
    """Counts, precision and recall per group; a ratio without cases is 1."""
    found = F.col("expect") == "found"
    is_ = lambda s: F.col("status") == s
    out = statuses.groupBy(*by).agg(
        F.count_if(is_("PASS")).alias("passed"), F.count_if(is_("FAIL")).alias("failed"),
        F.count_if(is_("FP")).alias("false_positives"), F.count(F.lit(1)).alias("total"),
        F.count_if(found & is_("PASS")).alias("_tp"), F.count_if(found & is_("FAIL")).alias("_fn"),
    )
    tp, fp, fn = F.col("_tp"), F.col("false_positives"), F.col("_fn")
    return out.select(
        *by, "passed", "failed", "false_positives", "total",
        _ratio(tp, tp + fp, empty).alias("precision"), _ratio(tp, tp + fn, empty).alias("recall"),
    )


def baseline_expectations(baseline: DataFrame, findings: DataFrame) -> DataFrame:
    """(cwe, passed, reason): enough findings, and for each expected file a finding with its evidence.

    ``baseline`` has one row per expected file (cwe, min_findings, pos, file, evidence_contains). The
    expectations of a CWE are few and travel with its findings; only distinct hits are aggregated.
    """
    expected = baseline.groupBy("cwe").agg(
        F.max("min_findings").alias("min_findings"),
        F.array_sort(F.collect_list(F.struct("pos", "file", "evidence_contains"))).alias("_exp"),
    )
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("evidence", "description", "title")]))
    joined = findings.select("cwe", F.col("file").alias("_file"), text.alias("_text")).join(expected.select("cwe", "_exp"), "cwe")
    hits = joined.select(
        "cwe",
        F.explode(F.filter("_exp", lambda e: F.contains(F.col("_file"), e["file"]))).alias("e"), "_text",
    )
    words = (
        hits.select("cwe", F.col("e.pos").alias("pos"), F.explode_outer(
            F.filter("e.evidence_contains", lambda k: F.contains(F.col("_text"), F.lower(k)))).alias("w"))
        .distinct().groupBy("cwe", "pos").agg(F.count("w").alias("n_words"))
    )
    found = words.groupBy("cwe").agg(F.map_from_entries(F.collect_list(F.struct("pos", "n_words"))).alias("_found"))
    total = joined.groupBy("cwe").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0).cast("bigint"))

    def problem(e: Column) -> Column:
        got = F.try_element_at("_found", e["pos"])
        need = F.size(F.array_distinct(F.coalesce(e["evidence_contains"], F.array().cast("array<string>"))))
        return (
            F.when(e["file"].isNull(), F.lit(None).cast("string"))
            .when(got.isNull(), F.concat(F.lit("no findings in "), e["file"]))
            .when(got < need, F.concat(F.lit("evidence keywords not matched in "), e["file"]))
        )

    first = F.try_element_at(F.filter(F.transform("_exp", problem), lambda p: p.isNotNull()), F.lit(1))
    few = F.concat(F.lit("expected "), F.col("min_findings").cast("string"), F.lit("+ findings, got "), n.cast("string"))
    reason = F.when(n < F.col("min_findings"), few).otherwise(first)
    return (
        expected.join(total, "cwe", "left").join(found, "cwe", "left")
        .select("cwe", n.alias("n_findings"), reason.isNull().alias("passed"), reason.alias("reason"))
    )


def compare_locations(actual: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Distinct (by, file, line) with state matched, missing or unexpected."""
    keys = [*by, "file", "line"]
    sides = actual.select(*keys, F.lit(True).alias("_a"), F.lit(False).alias("_e")).unionAll(
        expected.select(*keys, F.lit(False), F.lit(True))
    )
    return sides.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_e").alias("_e")).select(
        *keys,
        F.when(F.col("_a") & F.col("_e"), F.lit("matched")).when(F.col("_e"), F.lit("missing"))
        .otherwise(F.lit("unexpected")).alias("state"),
    )


def pass_cell(found: Column, minimum: Column, error: Column) -> Column:
    """PASS, PART, FAIL or ERR of one result."""
    return (
        F.when(error.isNotNull(), F.lit("ERR")).when(found >= minimum, F.lit("PASS"))
        .when(found > 0, F.lit("PART")).otherwise(F.lit("FAIL"))
    )


def pass_matrix(results: DataFrame, providers: list[str]) -> DataFrame:
    """One row per CWE with a column per provider and the verdict over all of them.

    ``results`` has (cwe, provider, found, expected_min, error), one row per pair.
    """
    cells = results.withColumn("cell", pass_cell(F.col("found"), F.col("expected_min"), F.col("error")))
    is_ = lambda s: F.count_if(F.col("cell") == s)
    state = (
        F.when(is_("PASS") == len(providers), F.lit("all-pass")).when(is_("PASS") > 0, F.lit("partial"))
        .when(is_("ERR") > 0, F.lit("err")).otherwise(F.lit("fail"))
    )
    return cells.groupBy("cwe").agg(
        *[F.max(F.when(F.col("provider") == p, F.col("cell"))).alias(p) for p in providers], state.alias("state")
    )


def provider_scores(results: DataFrame) -> DataFrame:
    """Passes over the results without error, per provider."""
    ok = F.col("error").isNull()
    return results.groupBy("provider").agg(
        F.count_if(ok & (F.col("found") >= F.col("expected_min"))).alias("passes"), F.count_if(ok).alias("total")
    )


def version_delta(results: DataFrame, old: str, new: str) -> DataFrame:
    """Pass rate per provider, CWE and version, and new minus old when both have runs."""
    ok = F.col("error").isNull() & (F.col("found") >= F.col("expected_min"))
    rate = lambda v: F.avg(F.when(F.col("version") == v, ok.cast("double")))
    return results.groupBy("provider", "cwe").agg(rate(old).alias("rate_old"), rate(new).alias("rate_new")).withColumn(
        "delta", F.col("rate_new") - F.col("rate_old")
    )


def run_stability(metrics: DataFrame) -> DataFrame:
    """Mean and population deviation of F2 over the runs of a model, and its median run.

    ``metrics`` has one row per model and run, so each group holds as many rows as there were runs.
    """
    by_f = Window.partitionBy("model").orderBy("f_beta", "run_no")
    every = Window.partitionBy("model")
    ranked = metrics.select(
        "model", "run_no", "f_beta", F.row_number().over(by_f).alias("_rn"), F.count(F.lit(1)).over(every).alias("n_runs"),
        F.avg("f_beta").over(every).alias("mean_f"), F.stddev_pop("f_beta").over(every).alias("stddev_f"),
    )
    return ranked.filter(F.col("_rn") == F.floor(F.col("n_runs") / 2) + 1).select(
        "model", "n_runs", "mean_f", "stddev_f", F.col("run_no").alias("median_run"), F.col("f_beta").alias("median_f")
    )


def best_model(metrics: DataFrame) -> DataFrame:
    """F2 of each model with its distance to the best one (one row per model)."""
    best = F.max("f_beta").over(Window.partitionBy())
    return metrics.select("model", "f_beta", (F.col("f_beta") - best).alias("delta"))


def vote_verdicts(findings: DataFrame, votes: DataFrame, samples: Column, key: str = "finding_id") -> DataFrame:
    """Verdict of every finding from its votes, counted against the samples asked for.

    Confirmed needs a strict majority of the requested samples; a failed sample is no vote. A finding
    without votes needs context and is ``unresolved``.
    """
    cast = votes.filter(~F.coalesce("failed", F.lit(False)) & F.col("vote").isNotNull())
    counts = cast.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_votes"), F.count_if(F.col("vote") == "CONFIRMED").alias("_c"),
        F.max(F.col("vote") == "FALSE_POSITIVE").alias("_fp"), F.min_by("vote", "sample_id").alias("_first"),
    )
    n = F.coalesce("n_votes", F.lit(0).cast("bigint"))
    verdict = (
        F.when(n == 0, F.lit("NEEDS_CONTEXT")).when(samples == 1, F.col("_first"))
        .when(F.col("_c") * 2 > samples, F.lit("CONFIRMED")).when(F.col("_fp"), F.lit("FALSE_POSITIVE"))
        .otherwise(F.lit("NEEDS_CONTEXT"))
    )
    return findings.join(counts, key, "left").select(
        *findings.columns, n.alias("n_votes"), verdict.alias("verdict"), (n == 0).alias("unresolved")
    )
