"""Tracking across runs, run diff, running cost, budget cut-off, incremental rebuild."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintmark.operators.prefix import running_totals


def first_places(tracked: DataFrame, order: list[str]) -> DataFrame:
    """Per fingerprint ``_fp`` the place and the run of its first row, found by an aggregation with a map-side step."""
    return tracked.groupBy(F.col("fingerprint").alias("_fp")).agg(
        F.min(F.struct(F.struct(*order).alias("o"), F.col("run_id").alias("r"))).alias("_first"))


def first_seen(tracked: DataFrame, order: list[str], first: DataFrame | None = None) -> DataFrame:
    """Add ``first_seen_run`` and ``status``: new for the first row of a fingerprint, else recurring.

    The first rows, ``first`` if they are known already, are joined back, so a fingerprint that holds a third of all rows
    is split like any skewed join side.
    """
    place = F.struct(*order)
    first = first_places(tracked, order) if first is None else first
    return tracked.join(first, F.col("fingerprint") == F.col("_fp")).select(
        *tracked.columns,
        F.col("_first.r").alias("first_seen_run"),
        F.when(place == F.col("_first.o"), F.lit("new")).otherwise(F.lit("recurring")).alias("status"),
    )


def key_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with ``side``: common, only_a or only_b; one shuffle, aggregated before it."""
    both = a.select(*keys, F.lit(True).alias("_a"), F.lit(False).alias("_b")).unionAll(
        b.select(*keys, F.lit(False).alias("_a"), F.lit(True).alias("_b"))
    )
    return both.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).select(
        *keys,
        F.when(F.col("_a") & F.col("_b"), F.lit("common"))
        .when(F.col("_a"), F.lit("only_a"))
        .otherwise(F.lit("only_b"))
        .alias("side"),
    )


def running_cost(calls: DataFrame, by: list[str], order: list[str], slice_by: Column | None = None) -> DataFrame:
    """Add ``cumulative_usd``, the spend up to and including each call."""
    out = running_totals(calls, by, order, {"_before": F.col("cost_usd")}, slice_by)
    kind = calls.schema["cost_usd"].dataType
    return out.withColumn("cumulative_usd", (F.col("_before") + F.col("cost_usd")).cast(kind)).drop("_before")


def budget_cutoff(
    calls: DataFrame, by: list[str], order: list[str], batch_size: int, limit: float,
    slice_by: Column | None = None,
) -> DataFrame:
    """Replay of a budget stop: a batch runs only if the spend before it is below the limit (0 = no limit).

    Adds ``batch_no``, ``cost_before`` (spend before the batch) and ``ran``.
    """
    out = running_totals(calls, by, order, {"_n": F.lit(1).cast("bigint"), "_c": F.col("cost_usd")}, slice_by)
    out = out.withColumn("batch_no", F.floor(F.col("_n") / batch_size))
    starts = out.filter(F.col("_n") % batch_size == 0).select(
        *[F.col(b).alias(f"_k_{b}") for b in by], F.col("batch_no").alias("_k_batch"), F.col("_c").alias("cost_before")
    )
    joined = out.join(
        starts, [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by] + [F.col("batch_no") == F.col("_k_batch")]
    )
    ran = (F.col("cost_before") < limit) | F.lit(limit <= 0)
    return joined.select(*calls.columns, "batch_no", "cost_before", ran.alias("ran"))


def cost_totals(calls: DataFrame, by: list[str], limit: float = 0.0) -> DataFrame:
    """Spend, calls and tokens per group, and whether the limit is reached (0 = no limit)."""
    total = F.sum("cost_usd")
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"), total.alias("cost_usd"),
        ((total >= limit) & F.lit(limit > 0)).alias("exceeded"),
    )


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state) from two (path, sha256) snapshots: new, modified, deleted or unchanged."""
    sides = old.select("path", F.col("sha256").alias("o"), F.lit(None).cast("string").alias("n")).unionAll(
        new.select("path", F.lit(None).cast("string"), "sha256")
    )
    o, n = F.col("o"), F.col("n")
    return sides.groupBy("path").agg(F.max("o").alias("o"), F.max("n").alias("n")).select(
        "path",
        F.when(o.isNull(), F.lit("new")).when(n.isNull(), F.lit("deleted")).when(o != n, F.lit("modified"))
        .otherwise(F.lit("unchanged")).alias("state"),
    )


def replace_changed(stored: DataFrame, fresh: DataFrame, changes: DataFrame, path: str = "file") -> DataFrame:
    """Next snapshot of a table keyed by file: rows of unchanged files stay, changed files' rows are new.

    Serves symbols, call edges and reference edges alike, so a reloaded graph keeps its references.
    """
    changed = changes.filter(F.col("state") != "unchanged").select(F.col("path").alias(path))
    live = changes.filter(F.col("state").isin("new", "modified")).select(F.col("path").alias(path))
    return stored.join(changed, path, "left_anti").unionByName(fresh.join(live, path, "left_semi"))
