"""Small lookup tables. Their size is fixed by the constants, so joins may broadcast them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintmark.functions import constants as K
from glintmark.functions.text import glob_regex


def cwe_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        K.CWE_REGISTRY,
        "cwe_id string, name string, detection string, file_types array<string>, direction string, hops int",
    )


def cwe_checks(spark: SparkSession) -> DataFrame:
    """Registry entries a model checks, with the key of their sink patterns."""
    return cwe_registry(spark).filter(F.col("detection").isin(K.MODEL_DETECTIONS)).withColumn(
        "sinks", F.when(F.col("direction").isin("backward", "both"), F.col("cwe_id"))
    )


def check_words(spark: SparkSession) -> DataFrame:
    """(cwe_id, word): path words of the file types of each check."""
    rows = [
        (cwe, word)
        for cwe, _, detection, types, _, _ in K.CWE_REGISTRY if detection in K.MODEL_DETECTIONS
        for word in sorted({w for t in types for w in K.FILE_TYPE_WORDS.get(t, [t])})
    ]
    return spark.createDataFrame(rows, "cwe_id string, word string")


def sink_patterns(spark: SparkSession) -> DataFrame:
    """(language, cwe_id, pattern, regex, last): ``last`` is the final name of the pattern."""
    rows = [
        (lang, cwe, p, glob_regex(p), p.rsplit(".", 1)[-1]) for lang, cwe, ps in K.SINK_PATTERNS for p in ps
    ]
    return spark.createDataFrame(rows, "language string, cwe_id string, pattern string, regex string, last string")


def scanners(spark: SparkSession) -> DataFrame:
    """(tool, pattern, regex) with one row per pattern; a tool that reads all files has a null pattern."""
    rows = [
        (tool, p, glob_regex(p) if p else None) for tool, ps, _ in K.SCANNERS for p in (ps or [None])
    ]
    return spark.createDataFrame(rows, "tool string, pattern string, regex string")


def rule_cwe_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.RULE_CWE, "tool string, rule_id string, mapped_cwe string")


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.PRICES, "price_key string, price_in double, price_out double")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.MODEL_ALIASES.items()), "alias string, model string")


def provider_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.PROVIDER_MODELS, "provider string, model string, wire string")


def providers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in K.PROVIDERS], "provider string")


def weight_profile(spark: SparkSession, profile: str = "production") -> DataFrame:
    weights = K.WEIGHT_PROFILES.get(profile, K.WEIGHT_PROFILES["production"])
    return spark.createDataFrame(list(zip(K.DIMENSIONS, weights)), "dim string, weight double")


def read_mapping(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A lookup table kept as JSON lines instead of the fixed values."""
    return spark.read.schema(schema).json(path)
