"""Running totals and ranks over groups too large for one task.

A plain ``Window.partitionBy(group).orderBy(...)`` puts a whole group in one task. Here rows are range
partitioned by (group, order) first, so a hot group spreads over many slices; each slice is totalled, the
totals (at most groups + slices rows) get a window of their own, and rows add the total of the slices before
theirs to a running total inside their own slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from glintmark.session import settle

_SLICE = "_slice"


def _slices(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_totals(
    df: DataFrame,
    by: list[str],
    order: list[Column | str],
    measures: dict[str, Column],
    slice_by: Column | None = None,
) -> DataFrame:
    """Add, per measure, the total over the rows before this one in its group (``name`` = total before).

    ``order`` must be a total order. ``slice_by`` may name an expression that grows with ``order`` and
    bounds the rows it holds (a unique integer divided by a width, say); then nothing is written and the
    plan stays lazy. Without it rows are range partitioned, and the partitioned rows are written once so
    that every reader sees the same slices.
    """
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    values = df.select("*", *[m.alias(f"_m_{n}") for n, m in measures.items()])
    exact = {n: values.schema[f"_m_{n}"].dataType for n in measures}

    def fixed(name: str, value: Column) -> Column:
        """Decimal sums keep the scale of their measure."""
        return value.cast(exact[name]) if isinstance(exact[name], DecimalType) else value

    if slice_by is not None:
        sliced = values.withColumn(_SLICE, slice_by)
    else:
        sliced = settle(
            values.repartitionByRange(_slices(df), *[F.col(b) for b in by], *order_cols)
            .withColumn(_SLICE, F.spark_partition_id()),
            "slices",
        )
    before = Window.partitionBy(*by).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*by, _SLICE)
        .agg(*[fixed(n, F.sum(f"_m_{n}")).alias(f"_t_{n}") for n in measures])
        .select(
            *[F.col(b).alias(f"_k_{b}") for b in by],
            F.col(_SLICE).alias("_k_slice"),
            *[fixed(n, F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0))).alias(f"_o_{n}") for n in measures],
        )
    )
    joined = sliced.join(
        offsets,
        [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by] + [F.col(_SLICE) == F.col("_k_slice")],
    )
    inside = Window.partitionBy(*by, _SLICE).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(
        *df.columns,
        *[
            fixed(n, F.col(f"_o_{n}") + fixed(n, F.coalesce(F.sum(f"_m_{n}").over(inside), F.lit(0)))).alias(n)
            for n in measures
        ],
    )


def numbered(df: DataFrame, by: list[str], order: list[Column | str], name: str = "rank_no",
             slice_by: Column | None = None) -> DataFrame:
    """1-based position of each row in its group.

    Without ``slice_by`` rows are shuffled once: ranges are sorted and written with the number each row has in its range, and a
    row's position follows from the number of its group's first row there and the totals of the ranges before.
    """
    if slice_by is not None:
        out = running_totals(df, by, order, {"_before": F.lit(1).cast("bigint")}, slice_by)
        return out.withColumn(name, (F.col("_before") + 1).cast("bigint")).drop("_before")
    keys = [*[F.col(b) for b in by], *[F.col(o) if isinstance(o, str) else o for o in order]]
    ranges = df.repartitionByRange(_slices(df), *keys).sortWithinPartitions(*keys)
    rows = settle(ranges.withColumn("_at", F.monotonically_increasing_id()), "slices").withColumn(_SLICE, F.shiftright("_at", 33))
    totals = settle(rows.groupBy(*by, _SLICE).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")), "totals")
    before = Window.partitionBy(*by).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(b).alias(f"_k_{b}") for b in by], F.col(_SLICE).alias("_k_slice"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by] + [F.col(_SLICE) == F.col("_k_slice")]
    return rows.join(offsets, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))


def histogram(df: DataFrame, by: list[str], value: str, slices: int = 64) -> DataFrame:
    """Distinct values of a group with their count ``n``, the count of smaller values ``n_before`` and of all, ``n_all``.

    The values of a group are cut into about ``slices`` ranges at approximate quantiles of its distinct values; ranges are totalled
    and only their totals meet per group, so no task holds more than a slice of a group's values. The cuts decide only who
    counts what: the counts are exact. The counts per value are written once.
    """
    keys = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    counts = settle(rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")), "histogram")
    cuts = counts.groupBy(*[F.col(k).alias(f"_c_{k}") for k in keys]).agg(
        F.percentile_approx(value, [k / slices for k in range(1, slices)], 10 * slices).alias("_cuts"), F.sum("n").alias("n_all"))
    same = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys]
    placed = counts.join(cuts, same).select(*keys, value, "n", "n_all", F.size(F.filter("_cuts", lambda c: c < F.col(value))).alias("_slice"))
    totals = placed.groupBy(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_slice").alias("_c_slice")).agg(F.sum("n").alias("_in"))
    earlier = Window.partitionBy(*[f"_c_{k}" for k in keys]).orderBy("_c_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
    inside = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(offsets, [*same, F.col("_slice") == F.col("_c_slice")]).select(
        *by, value, "n", (F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("n_before"), "n_all")


def index_percentile(df: DataFrame, by: list[str], value: str, share: float, name: str) -> DataFrame:
    """Element at position ``min(int(n * share), n - 1)`` of the sorted values, from their histogram."""
    at = F.least(F.floor(F.col("n_all") * F.lit(share)), F.col("n_all") - 1)
    return (
        histogram(df, by, value)
        .filter((F.col("n_before") <= at) & (at < F.col("n_before") + F.col("n")))
        .select(*by, F.col(value).alias(name))
    )


def gini(df: DataFrame, by: list[str], value: str, name: str = "gini") -> DataFrame:
    """Gini coefficient; 0 for fewer than two values or a zero total.

    A value held by ``n`` rows after ``b`` smaller ones fills positions b+1 .. b+n, so the positions sum to
    ``n*b + n*(n+1)/2`` and no row needs a rank of its own.
    """
    n, before, v, total = F.col("n"), F.col("n_before"), F.col(value), F.col("n_all")
    positions = n * before + n * (n + 1) / 2
    return (
        histogram(df, by, value)
        .groupBy(*by)
        .agg(
            F.sum((2 * positions - n * (total + 1)) * v).alias("_weighted"),
            F.sum(n * v).alias("_sum"),
            F.max(total).alias("_n"),
        )
        .select(
            *by,
            F.when((F.col("_n") < 2) | (F.col("_sum") == 0), F.lit(0.0))
            .otherwise(F.col("_weighted") / (F.col("_n") * F.col("_sum")))
            .alias(name),
        )
    )
