"""Connected components by alternating large and small stars; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintmark.session import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours on one side of it, linked to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    side = both.join(least, "u").filter("v > u" if large else "v <= u")
    linked = side.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    return linked.filter("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for every node of ``links``; rounds grow with the log of the longest path.

    A node's many neighbours are never gathered: a round is one minimum per node with a map-side step, and a join
    that adaptive execution may split. Self links are left out; no links give no rows.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "components")
    edges = scratch.save(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "r0")
    mark, turn = None, 0
    while True:
        wide = _stars(edges, large=True).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        turn += 1
        after = scratch.save(_stars(wide, large=False), f"r{turn}")
        now = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(f"r{turn - 1}")
        if now == mark:
            break
        edges, mark = after, now
    roots = after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
