"""Source trees as tables: inventory, code-analysis collection, evidence hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintmark.functions import constants as K
from glintmark.functions import paths as P
from glintmark.functions.text import tokens_of_bytes


def read_tree(spark: SparkSession, root: str, max_bytes: int | None = K.INVENTORY_MAX_BYTES) -> DataFrame:
    """(path, size_bytes, content) of the files below ``root``; content of files over ``max_bytes`` is null and not read."""
    base = root.rstrip("/") + "/"
    full = F.regexp_replace("path", "^file:/*(?=/)", "")
    tree = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name, size = F.substring_index(full, base, -1).alias("path"), F.col("length").alias("size_bytes")
    if max_bytes is None:
        return tree.select(name, size, "content")
    # Two scans with a pushed-down size filter each: large contents are never loaded.
    small = tree.filter(F.col("length") <= max_bytes).select(name, size, "content")
    large = tree.filter(F.col("length") > max_bytes).select(name, size, F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def text_content(content: Column | str = "content") -> Column:
    """File content as text; bytes that are not UTF-8 become the replacement character."""
    return F.decode(F.col(content) if isinstance(content, str) else content, "UTF-8")


def inventory(
    files: DataFrame, exclude: list[str] | None = None, include: list[str] | None = None,
    max_bytes: int = K.INVENTORY_MAX_BYTES, strip_dots: bool = False, text: str = "text",
    chars: int | None = K.CONTENT_WEIGHT_CHARS,
) -> DataFrame:
    """Manifest of a table of files (path, size_bytes, text): language, weight and token estimate.

    The weight reads the first ``chars`` characters of a text, or all of it if None.
    """
    path = F.col("path")
    shown = F.ltrim(path, F.lit("./")) if strip_dots else path
    kept = files.filter(
        (F.col("size_bytes") <= max_bytes)
        & P.inventoried(path, exclude, strip_dots)
        & P.passes_filters(shown, exclude or [], include or [])
    ).withColumn("language", P.language(path))
    return P.with_security_weight(kept, text, chars=chars).select(
        "path", "language", "size_bytes", "weight", tokens_of_bytes(F.col("size_bytes")).alias("tokens"))


def inventory_losses(
    files: DataFrame, exclude: list[str] | None = None, include: list[str] | None = None,
    max_bytes: int = K.INVENTORY_MAX_BYTES, strip_dots: bool = False,
) -> DataFrame:
    """(path, size_bytes, reason) of the files that ``inventory`` leaves out: excluded, filtered or too large."""
    path = F.col("path")
    shown = F.ltrim(path, F.lit("./")) if strip_dots else path
    reason = (
        F.when(~P.inventoried(path, exclude, strip_dots), "excluded")
        .when(~P.passes_filters(shown, exclude or [], include or []), "filtered")
        .when(F.col("size_bytes") > max_bytes, "too_large")
    )
    return files.select("path", "size_bytes", reason.alias("reason")).filter("reason IS NOT NULL")


def without_sensitive(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that may be sent on, withheld files as path and reason): environment files may hold live secrets."""
    hit = P.is_sensitive_env(F.col("path"))
    return files.filter(~hit), files.filter(hit).select("path", F.lit("sensitive_file_omitted").alias("reason"))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """Files and tokens per language."""
    return manifest.groupBy("language").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("tokens").alias("n_tokens")
    )


def by_weight(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy(F.desc("weight"), "path")


def collect_sources(
    files: DataFrame, scope: list[str] | None = None, exclude: list[str] | None = None,
    extensions: list[str] | None = None,
) -> DataFrame:
    """Files of a table that code analysis reads."""
    keep = P.collected(F.col("path"), exclude, extensions)
    if scope:
        keep = keep & P.in_scope(F.col("path"), scope)
    return files.filter(keep)


def evidence(files: DataFrame, source: Column, content: str = "content") -> DataFrame:
    """(path, sha256, size_bytes, source) per artefact."""
    return files.select(
        "path", F.sha2(F.col(content), 256).alias("sha256"),
        F.octet_length(F.col(content)).cast("bigint").alias("size_bytes"), source.alias("source"),
    )


def require_unique_paths(entries: DataFrame) -> DataFrame:
    """Fails the job that reads it when a path occurs twice."""
    counts = entries.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("*")).alias("row"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate evidence path: "), "path"))
                     .cast("string")).otherwise(F.col("path"))
    return counts.select(checked.alias("path"), *[F.col(f"row.{c}") for c in entries.columns if c != "path"])
