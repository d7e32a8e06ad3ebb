"""Normalise, filter and score findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmark.functions import constants as K
from glintmark.functions import levels as L
from glintmark.functions import tags as T
from glintmark.functions.paths import normal_uri
from glintmark.functions.text import redact


def normalise_places(findings: DataFrame, root: str | None = None) -> DataFrame:
    """Relative file paths and redacted texts, before any key is built from them."""
    out = findings.withColumn("file", normal_uri(F.col("file"), root))
    for c in ("message", "snippet", "context"):
        if c in findings.columns:
            out = out.withColumn(c, redact(F.col(c)))
    return out


def rule_attributes(rules: DataFrame, by: list[str]) -> DataFrame:
    """One row per rule: its default level and first CWE tag. The last rule with a level sets the level."""
    order = F.struct(*[F.col(c) for c in ("doc", "run_pos", "rule_pos") if c in rules.columns])
    tag = T.first_tag_number(F.col("tags"))
    has_level = F.col("default_level").isNotNull()
    return rules.groupBy(*by, "rule_id").agg(
        F.max(F.when(has_level, F.struct(order.alias("o"), "default_level")))["default_level"].alias("rule_level"),
        F.max(F.when(tag.isNotNull(), F.struct(order.alias("o"), F.concat(F.lit("CWE-"), tag).alias("c"))))["c"]
        .alias("rule_cwe"),
    )


def resolve_levels(findings: DataFrame, attributes: DataFrame, by: list[str], tool: str = "tool") -> DataFrame:
    """Give every finding a level, looking up its rule's default level."""
    level = L.resolve_level(F.col("level"), F.col("issue_severity"), F.col("rule_level"), F.col(tool))
    return (
        findings.join(attributes.select(*by, "rule_id", "rule_level"), [*by, "rule_id"], "left")
        .withColumn("level", level)
        .drop("rule_level")
        .select(*findings.columns)
    )


def rule_cwe_fallback(findings: DataFrame, attributes: DataFrame, by: list[str]) -> DataFrame:
    """Use the rule's CWE where the finding names none."""
    own = F.when(F.col("cwe") != "", F.col("cwe"))
    return (
        findings.join(attributes.select(*by, "rule_id", "rule_cwe"), [*by, "rule_id"], "left")
        .withColumn("cwe", F.coalesce(own, F.col("rule_cwe")))
        .select(*findings.columns)
    )


def in_manifest(findings: DataFrame, manifest: DataFrame) -> DataFrame:
    """Findings in a file of the manifest."""
    return findings.join(manifest.select("file"), "file", "left_semi").select(*findings.columns)


def outside_manifest(findings: DataFrame, manifest: DataFrame) -> DataFrame:
    return findings.join(manifest.select("file"), "file", "left_anti").select(*findings.columns)


def with_exposure(findings: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add the exposure of the finding's file. A file that the manifest names more than once has its largest weight,
    and findings are never multiplied. Spark broadcasts the manifest only while it is small."""
    weights = manifest.groupBy("file").agg(F.max("weight").alias("_w"))
    return (
        findings.join(weights, "file", "left")
        .withColumn("exposure", L.exposure(F.col("_w")))
        .select(*findings.columns, "exposure")
    )


def score(findings: DataFrame, verification: bool = False, use_verdict: bool = True) -> DataFrame:
    """Priority = severity x confidence x exposure, rounded to 3, with its parts and its band."""
    verdict = L.effective_verdict(F.col("verdict"), F.col("rule_id"), verification) if use_verdict else F.lit(None).cast("string")
    label = L.confidence_label(verdict, F.col("rule_id")) if use_verdict else F.lit("sast_only")
    out = (
        findings.withColumn("verdict", verdict if use_verdict else F.col("verdict"))
        .withColumn("confidence_label", F.coalesce(label, F.lit("sast_only")))
        .withColumn("severity_score", L.severity_score(F.col("level")))
        .withColumn("confidence_score", L.confidence_score(F.col("confidence_label")))
        .withColumn(
            "priority",
            F.round(F.col("severity_score") * F.col("confidence_score") * F.col("exposure"), 3),
        )
    )
    return out.withColumn("band", L.band(F.col("priority")))


def prescore(findings: DataFrame, manifest: DataFrame) -> DataFrame:
    """Score before any verdict exists, to choose what is worth a verdict."""
    return score(with_exposure(findings, manifest), use_verdict=False)


def worth_triage(scored: DataFrame, minimum: float = K.TRIAGE_MIN_SCORE) -> DataFrame:
    return scored.filter(F.col("priority") >= minimum)


def triage_counts(scored: DataFrame, by: list[str], minimum: float = K.TRIAGE_MIN_SCORE) -> DataFrame:
    """How many findings reach the threshold and how many are skipped, in one pass."""
    keep = F.col("priority") >= minimum
    return scored.groupBy(*by).agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("skipped"))


def map_rules(results: DataFrame, rules: DataFrame, mapping: DataFrame, registry: DataFrame,
              by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Add mapped CWE tags to rules and results, and rules for mapped results that have none.

    Spark broadcasts ``mapping`` (tool, rule_id, mapped_cwe) only while it is small. A mapped CWE outside the
    registry fails the job. Mapping twice changes nothing.
    """
    number = T.bare_number(F.regexp_replace("mapped_cwe", "^CWE-", ""))
    known = mapping.join(registry.select("cwe_id"), number == F.col("cwe_id"), "left").select(
        F.col("tool").alias("_tool"), F.col("rule_id").alias("_rule"),
        F.when(F.col("cwe_id").isNull(),
               F.raise_error(F.concat("rule_id", F.lit(" maps to a CWE outside the registry: "), "mapped_cwe")).cast("string"))
        .otherwise(F.concat(F.lit(T.CWE_TAG), T.padded(number))).alias("_tag"),
    )
    on = (F.lower("tool") == F.col("_tool")) & (F.col("rule_id") == F.col("_rule"))
    old = F.coalesce("tags", F.array().cast("array<string>"))
    tagged = F.when(F.col("_tag").isNull() | F.array_contains(old, F.col("_tag")), F.col("tags")).otherwise(
        F.array_append(old, F.col("_tag"))
    )
    new_results = results.join(known, on, "left")
    new_rules = rules.join(known, on, "left")
    made = (
        new_results.filter(F.col("_tag").isNotNull())
        .select(*by, "tool", "rule_id", "_tag").distinct()
        .join(rules.select(*by, "rule_id"), [*by, "rule_id"], "left_anti")
        .select(*by, "tool", "rule_id", F.array(F.lit("security"), "_tag").alias("tags"))
    )
    return (
        new_results.withColumn("tags", tagged).select(*results.columns),
        new_rules.withColumn("tags", tagged).select(*rules.columns).unionByName(made, allowMissingColumns=True),
    )


def model_rows(model: DataFrame) -> DataFrame:
    """Model findings in the columns of scanner findings; an unresolved file leaves no location."""
    placed = F.coalesce((F.col("file") != "") & (F.col("file") != "unknown"), F.lit(False))
    number = T.bare_number(F.regexp_extract("cwe", r"(\d+)", 1))
    return model.select(
        "*",
        L.severity_to_level(F.col("severity")).alias("level"),
        F.concat("title", F.lit(": "), "description").alias("message"),
        F.array(F.concat(F.lit(T.CWE_TAG), T.padded(number)), F.lit("security")).alias("tags"),
        (~placed).alias("location_unresolved"),
        F.when(placed, F.col("file")).alias("_file"),
        F.when(placed, F.coalesce(F.nullif("line", F.lit(0)), F.lit(1))).alias("_line"),
    ).drop("file", "line").withColumnsRenamed({"_file": "file", "_line": "line"})
