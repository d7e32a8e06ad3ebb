"""Exact deduplication: rows meet on a 128-bit hash of the normalised text, and bytes decide inside a hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintmark.llm.common import lower_ascii
from glintmark.session import settle


def content_hash(text: Column) -> Column:
    """128 bits of the text, as 16 bytes."""
    return F.unhex(F.md5(text))


def _classes(rows: DataFrame, keep: str) -> DataFrame:
    """One row per (hash, text): bytes are compared because the text is part of the key. Copies collapse before the shuffle."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    return rows.groupBy("_hash", "_norm").agg(pick("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                 normalise: Callable[[Column], Column] = lower_ascii, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """Every column of ``docs`` and ``_keep`` (id of the row that stays), ``_size``, ``_sha256`` (of the normalised text), ``_hash``.

    Groups form on the hash. The aggregation has hash and text in its key, so two texts never share a group; the
    group's figures alone, without text, are written once and joined to the rows on the hash, where a hot hash meets
    one row. Hashes that hold more than one text (a collision) are told apart by text in a join of their own.

    Null text counts as empty. ``keep`` is the ``smallest`` or ``largest`` id; null ids never win against others, and
    a group of null ids keeps null. Repeated rows count each. No rows give no rows. Columns of the input may have any
    name that does not start with an underscore.
    """
    rows = docs.withColumns({"_id": F.col(id_col), "_norm": normalise(F.coalesce(F.col(text_col), F.lit("")))})
    rows = rows.withColumn("_hash", hashed(F.col("_norm")))
    classes = _classes(rows.select("_id", "_norm", "_hash"), keep)
    figures = settle(classes.select("_hash", F.sha2("_norm", 256).alias("_sha256"), "_keep", "_size"), "exact")
    clash = figures.groupBy("_hash").count().filter("count > 1").select("_hash")
    if clash.isEmpty():
        return rows.drop("_norm", "_id").join(figures, "_hash")
    apart = rows.join(clash, "_hash", "left_semi")
    by_text = _classes(apart.select("_id", "_norm", "_hash"), keep).withColumn("_sha256", F.sha2("_norm", 256))
    told = apart.drop("_id").join(by_text, ["_hash", "_norm"]).drop("_norm")
    sole = rows.drop("_norm", "_id").join(figures.join(clash, "_hash", "left_anti"), "_hash")
    return sole.unionByName(told)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                normalise: Callable[[Column], Column] = lower_ascii) -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct normalised text, columns unchanged.

    Rows with the same id and the same text are the same row more than once; one of them stays.
    """
    grouped = exact_groups(docs, id_col, text_col, keep, normalise)
    kept = grouped.filter(F.col(id_col).eqNullSafe(F.col("_keep")))
    whole = grouped.select("_sha256", id_col)
    again = whole.groupBy("_sha256", id_col).count().filter("count > 1")
    if not again.isEmpty():
        kept = kept.dropDuplicates(["_sha256"])
    return kept.select(*docs.columns)
