"""Report tables: counts, ranks, gates, exports, losses, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintmark.functions import constants as K
from glintmark.functions import levels as L
from glintmark.functions.paths import base_name
from glintmark.functions.text import collapse_spaces, first_chars
from glintmark.operators.matching import scanners_of_file
from glintmark.operators.prefix import numbered
from glintmark.session import settle


def report_counts(scored: DataFrame, by: list[str]) -> DataFrame:
    """Totals per band, level and verdict."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[n("band", b).alias(b.lower()) for b, _ in K.BANDS],
        n("level", "error").alias("critical"), n("level", "warning").alias("medium"),
        n("level", "note").alias("low_severity"),
        *[n("verdict", v).alias(f"triage_{v.lower()}") for v in K.VERDICTS],
        F.max(F.coalesce(F.col("verdict") != "", F.lit(False))).alias("has_triage"),
    )


def verdict_totals(findings: DataFrame, by: list[str]) -> DataFrame:
    return findings.groupBy(*by).agg(
        *[F.count_if(F.col("verdict") == v).alias(f"total_{v.lower()}") for v in K.VERDICTS]
    )


def top_cwes(findings: DataFrame, order: list[str], limit: int = 10, by: list[str] | None = None) -> DataFrame:
    """Most frequent CWEs, of each group if ``by`` is given; ties by first appearance."""
    by = by or []
    counts = findings.filter(F.col("cwe") != "").groupBy(*by, "cwe").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("_first"))
    if not by:
        return counts.orderBy(F.desc("n"), "_first").limit(limit).select("cwe", "n")
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "_first")
    return counts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).select(*by, "cwe", "n")


def in_priority_order(scored: DataFrame, order: list[str]) -> DataFrame:
    return scored.orderBy(F.desc("priority"), *order)


def band_ranks(scored: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Add ``rank_no`` inside the band, in priority order; a hot band is numbered slice by slice."""
    return numbered(scored, [*by, "band"], [F.desc("priority"), *order])


def top_ranked(scored: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """First ``k`` findings per group; Spark keeps k rows per group and task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("priority"), *order)
    return scored.withColumn("rank_no", F.row_number().over(w)).filter(F.col("rank_no") <= k)


def actionable(scored: DataFrame, order: list[str], k: int = 20, minimum: float = K.TRIAGE_MIN_SCORE) -> DataFrame:
    """First ``k`` findings worth acting on; if none reaches the threshold, the first with any priority.

    The first k with any priority start with those that reach the threshold, so one top-k pass serves
    both cases and the choice is made over k rows.
    """
    top = in_priority_order(scored.filter(F.col("priority") > 0), order).limit(k)
    best = F.max("priority").over(Window.partitionBy())
    return top.withColumn("_best", best).filter((F.col("priority") >= minimum) | (F.col("_best") < minimum)).drop("_best")


def summary_rows(top: DataFrame, chars: int | None = 80) -> DataFrame:
    """Columns of the summary table: the first ``chars`` characters of the message (None: all) as ``finding``, all of it as ``message``."""
    return top.select(
        "band", "priority", L.display_level(F.col("level")).alias("severity"),
        L.display_verdict(F.col("verdict")).alias("status"), base_name(F.col("file")).alias("file"), "line",
        first_chars(collapse_spaces(F.col("message")), chars).alias("finding"), "message",
    )


def gate(counts: DataFrame, by: list[str], fail_on: str | None, fail_on_lost: bool = False,
         lost: DataFrame | None = None) -> DataFrame:
    """(by, gate): 3 if a finding reaches the band, else 4 if coverage was lost and that matters, else 0."""
    names = [b.lower() for b, _ in K.BANDS]
    hit = F.lit(False)
    for name in names[: names.index(fail_on) + 1] if fail_on else []:
        hit = hit | (F.col(name) > 0)
    out, degraded = counts, F.lit(False)
    if fail_on_lost and lost is not None:
        out = counts.join(lost.groupBy(*by).agg(F.count(F.lit(1)).alias("_lost")), by, "left")
        degraded = F.col("_lost").isNotNull()
    return out.select(*by, F.when(hit, F.lit(3)).when(degraded, F.lit(4)).otherwise(F.lit(0)).alias("gate"))


def export_rows(scored: DataFrame) -> DataFrame:
    """The twelve columns of the CSV export, all formatted as text but the line."""
    return scored.select(
        F.format_string("%.3f", "priority").alias("priority"), F.col("band").alias("priority_band"),
        L.display_level(F.col("level")).alias("severity"), "file", "line", "rule_id",
        F.coalesce("cwe", F.lit("")).alias("cwe"),
        F.when(F.coalesce(F.col("verdict"), F.lit("")) == "", F.lit("untriaged")).otherwise(F.col("verdict")).alias("status"),
        F.format_string("%.2f", "confidence_score").alias("confidence"), "confidence_label",
        F.format_string("%.2f", "exposure").alias("exposure"), collapse_spaces(F.col("message")).alias("message"),
    )


def write_csv(scored: DataFrame, order: list[str], path: str) -> None:
    """CSV files whose names sort in priority order."""
    ordered = in_priority_order(scored, order)
    export_rows(ordered).write.mode("overwrite").option("header", True).csv(path)


def json_reports(scored: DataFrame, counts: DataFrame, cwes: DataFrame, by: str, order: list[str],
                 max_findings: int = 5000, metadata: DataFrame | None = None) -> DataFrame:
    """JSON report per run in parts of ``max_findings`` findings, cut by rank, each with the summary of the run.

    Part after part, the findings stand in priority order; each names its ``position`` in the whole report.
    ``cwes`` has (by, cwe, n) with the top CWEs of each run; ``metadata`` may give more fields per run, such as
    target, mode, provider, timestamp and cost. Blocks without content are left out.
    """
    top = cwes.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("cwe", "n"))).alias("cwes"))
    triage = F.when(F.col("has_triage"), F.struct(*[
        F.col(f"triage_{v.lower()}").alias(v.lower()) for v in K.VERDICTS]))
    more = [c for c in metadata.columns if c != by] if metadata is not None else []
    known = counts.join(metadata, by, "left") if more else counts
    heads = known.join(top, by, "left").select(
        F.col(by).alias("_run"),
        F.struct(
            F.struct(F.col(by).cast("string").alias("run_id"), F.col("total").alias("total_findings"), *more).alias("metadata"),
            F.struct(
                F.struct(*[F.col(b.lower()) for b, _ in K.BANDS]).alias("priority"),
                F.struct("critical", "medium", F.col("low_severity").alias("low")).alias("severity"),
            ).alias("summary"),
            triage.alias("triage"), F.col("cwes"),
        ).alias("_head"),
    )
    heads = settle(heads, "heads")  # Spark then knows how small they are, and shuffles no report to meet them
    finding = F.struct(
        F.col("_rank").alias("position"), "priority", F.col("band").alias("priority_band"), L.display_level(F.col("level")).alias("severity"),
        "rule_id", "file", "line", collapse_spaces(F.col("message")).alias("message"), "cwe",
        F.col("confidence_score").alias("confidence"), "confidence_label", "exposure")
    columns = dict.fromkeys([by, *order, "priority", "band", "level", "rule_id", "file", "line", "message", "cwe", "confidence_score", "confidence_label", "exposure"])
    parts = (
        numbered(scored.select(*columns), [by], [F.desc("priority"), *order], "_rank")
        .withColumn("part", F.floor((F.col("_rank") - 1) / max_findings).cast("int"))
        .groupBy(by, "part").agg(F.array_sort(F.collect_list(finding)).alias("findings"))
    )
    return parts.join(heads, F.col(by) == F.col("_run")).select(
        by, "part", F.to_json(F.struct("_head.metadata", "_head.summary", "findings", "_head.triage", "_head.cwes")).alias("value"))


def loss_rollup(losses: DataFrame, by: list[str]) -> DataFrame:
    """Recorded losses and the quantity they stand for."""
    return losses.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.coalesce("count", F.lit(0))).alias("n_lost"))


def write_facts(facts: DataFrame, path: str, run: str = "run_id") -> None:
    """Fact table of the audit log (costs, losses, selections), a folder per run; writing a run again replaces it."""
    facts.write.partitionBy(run).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


_FACT = "run_id string, fact string, subject string, detail string, n bigint, amount decimal(28, 9)"


def audit_facts(costs: DataFrame | None = None, losses: DataFrame | None = None, failures: DataFrame | None = None,
                selection: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """The audit record of every run as rows (run_id, fact, subject, detail, n, amount), so that no run has to fit one document.

    ``costs`` (run_id, agent, model, cost_usd) become calls and money per agent and model, ``losses`` (run_id, pass, kind,
    subject, count) keep their counts, ``failures`` (run_id, pass, error_type, fatal) are counted, fatal ones apart,
    ``selection`` (run_id, check, via) gives files per check and way of selection, ``verdicts`` (run_id, verdict) their totals.
    """
    none, money = F.lit(None).cast("string"), F.lit(None).cast("decimal(28,9)")
    count = F.count(F.lit(1)).alias("n")
    parts = []
    if costs is not None:
        parts.append(costs.groupBy("run_id", "agent", "model").agg(count, F.sum("cost_usd").cast("decimal(28,9)").alias("amount")).select(
            "run_id", F.lit("cost").alias("fact"), F.col("agent").alias("subject"), F.col("model").alias("detail"), "n", "amount"))
    if losses is not None:
        parts.append(losses.groupBy("run_id", "pass", "kind", "subject").agg(F.sum("count").cast("bigint").alias("n")).select(
            "run_id", F.concat(F.lit("loss:"), "kind").alias("fact"), F.col("pass").alias("subject"), F.col("subject").alias("detail"), "n", money.alias("amount")))
    if failures is not None:
        parts.append(failures.groupBy("run_id", "pass", "error_type", "fatal").agg(count).select(
            "run_id", F.when(F.col("fatal"), F.lit("fatal")).otherwise(F.lit("failure")).alias("fact"), F.col("pass").alias("subject"), F.col("error_type").alias("detail"), "n", money.alias("amount")))
    if selection is not None:
        parts.append(selection.groupBy("run_id", "check", "via").agg(count).select("run_id", F.lit("selection").alias("fact"), F.col("check").alias("subject"), F.col("via").alias("detail"), "n", money.alias("amount")))
    if verdicts is not None:
        parts.append(verdicts.groupBy("run_id", "verdict").agg(count).select("run_id", F.lit("triage").alias("fact"), F.col("verdict").alias("subject"), none.alias("detail"), "n", money.alias("amount")))
    empty = (costs if costs is not None else next(p for p in (losses, failures, selection, verdicts) if p is not None)).sparkSession.createDataFrame([], _FACT)
    return reduce(DataFrame.unionByName, parts, empty)


def omitted_losses(packed: DataFrame, by: list[str], pass_name: str, order: list[str], shown: int = 5) -> DataFrame:
    """One loss row per group with files left out, naming the first few of them."""
    omitted = F.col("packed") == "omitted"
    ranked = packed.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"), F.count_if(omitted).alias("count"))
    w = Window.partitionBy(*by).orderBy(*order)
    names = (
        packed.filter(omitted).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= shown)
        .groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "file"))),
                                                   lambda x: x["file"]), ", ").alias("_names"))
    )
    more = F.when(F.col("count") > shown, F.lit("…")).otherwise(F.lit(""))
    return ranked.filter(F.col("count") > 0).join(names, by).select(
        *by, F.lit(pass_name).alias("pass"), F.lit("files_omitted").alias("kind"),
        F.concat(F.col("count").cast("string"), F.lit(" of "), F.col("_all").cast("string"),
                 F.lit(" selected files did not fit the token budget and were NOT reviewed: "), "_names", more).alias("detail"),
        "count",
    )


def coverage(manifest: DataFrame, available: DataFrame, full_mode: bool = True) -> DataFrame:
    """(language, n_files, tools, passes, level, label). Tool and pass lists are bounded by the fixed tables."""
    counts = manifest.groupBy("language").agg(F.count(F.lit(1)).alias("n_files"))
    tools = (
        manifest.select("language", F.explode(scanners_of_file(F.col("file"))).alias("tool")).distinct()
        .join(available.select("tool"), "tool", "left_semi")
        .groupBy("language").agg(F.array_sort(F.collect_set("tool")).alias("tools"))
    )
    none = F.array().cast("array<string>")
    passes = none
    if full_mode:
        for lang, names in K.SEMANTIC_PASSES.items():
            passes = F.when(F.col("language") == lang, F.array(*[F.lit(n) for n in names])).otherwise(passes)
    has_tool, has_pass = F.size("tools") > 0, F.size("passes") > 0
    level = F.when(has_tool & has_pass, F.lit("strong")).when(has_tool | has_pass, F.lit("weak")).otherwise(F.lit("none"))
    parts = F.array_join(F.concat("tools", F.transform("passes", lambda p: F.concat(F.lit("LLM "), p))), " + ")
    label = F.when(level == "none", F.lit("no coverage")).when(level == "weak", F.concat(parts, F.lit(" only"))).otherwise(parts)
    return (
        counts.join(tools, "language", "left")
        .select("language", "n_files", F.coalesce("tools", none).alias("tools"), passes.alias("passes"))
        .withColumns({"level": level, "label": label})
    )


def files_reviewed(checks: DataFrame, included: DataFrame) -> DataFrame:
    """Distinct files that completed checks really read."""
    done = checks.filter(F.col("outcome") == "completed").select("cwe_id")
    return included.filter(F.col("packed") != "omitted").join(done, "cwe_id", "left_semi").select("file").distinct()


def unresolved_places(findings: DataFrame, by: list[str]) -> DataFrame:
    return findings.groupBy(*by).agg(F.count_if(F.col("file") == "unknown").alias("n_unresolved"))


def work_list(selected: DataFrame) -> DataFrame:
    """Files per check with the number of distinct files over all checks; checks without files have no row."""
    every = selected.agg(F.count_distinct("file")).scalar()
    return selected.groupBy("cwe_id").agg(F.count(F.lit(1)).alias("n_files")).withColumn("n_files_all", every)


def score_json(scores: DataFrame, composite: DataFrame, by: str) -> DataFrame:
    """Quality result per project as JSON, scores rounded to one decimal."""
    dims = scores.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(
        "dim", F.struct(F.round("score", 1).alias("score"),
                        F.transform_values("sub_scores", lambda _, v: F.round(v, 1)).alias("sub_scores"))))).alias("dimensions"))
    return composite.join(dims, by).select(
        by, F.to_json(F.struct(F.round("composite", 1).alias("composite"), "quality_band",
                               F.round("floor_penalty", 3).alias("floor_penalty"), "dimensions")).alias("value"))
