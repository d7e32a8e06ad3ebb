"""Event ledger and run catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintmark.functions import constants as K


def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines to (ts, kind, run_id, fields); every other field stays in the map."""
    m = F.from_json(F.col(value), "map<string,string>")
    return lines.select(m.alias("m")).select(
        F.try_to_timestamp(F.col("m")["ts"]).alias("ts"), F.col("m")["kind"].alias("kind"),
        F.col("m")["run_id"].alias("run_id"),
        F.map_filter("m", lambda k, _: ~k.isin("ts", "kind", "run_id")).alias("fields"),
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(spark.read.text(path))


def event_line(ts, kind, **fields):
    """One ledger line as JSON text."""
    return F.to_json(F.struct(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), kind.alias("kind"),
                              *[c.alias(n) for n, c in fields.items()]))


def run_catalogue(
    runs: DataFrame, findings: DataFrame, losses: DataFrame, target: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Runs newest first with their totals, authorization findings and state.

    ``runs`` has (run_id, started, target); a run without any finding row is incomplete, one with a
    ``run_aborted`` loss is salvaged. Counts rows, not words in a report text.
    """
    counts = findings.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("cwe").isin(K.AUTHORIZATION_CWES)).alias("authz"),
    )
    aborted = losses.filter(F.col("kind") == "run_aborted").select("run_id").distinct().withColumn("_aborted", F.lit(True))
    out = runs.join(counts, "run_id", "left").join(aborted, "run_id", "left")
    if target:
        out = out.filter(F.lower("target").contains(target.lower()))
    out = out.select(
        "run_id", "started", "target", "total", "authz",
        F.when(F.col("total").isNull(), F.lit("incomplete"))
        .when(F.col("_aborted"), F.lit("salvaged"))
        .otherwise(F.lit("complete"))
        .alias("state"),
    ).orderBy(F.desc("started"), F.desc("run_id"))
    return out.limit(limit) if limit else out
