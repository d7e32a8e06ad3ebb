"""Fit ordered items into a token budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintmark.functions import constants as K
from glintmark.operators.prefix import running_totals


def pack_files(
    files: DataFrame, by: list[str], order: list[str], max_tokens: int = 100_000, reserve: int = 30_000,
    tokens: str = "tokens", slice_by: Column | None = None,
) -> DataFrame:
    """Add ``packed`` (included, truncated or omitted) and ``keep_chars`` of a truncated file.

    Files are taken in order while they fit. The first that does not fit is cut to what is left, if
    anything is; later ones are omitted unless they need no tokens. A null token count is an unreadable
    file, which only costs its note and is always included.
    """
    available = max_tokens - reserve
    need = F.coalesce(F.col(tokens), F.lit(0))
    out = running_totals(files, by, order, {"_n": F.lit(1).cast("bigint"), "_c": need}, slice_by)
    over = F.col("_c") + need > available
    firsts = out.groupBy(*[F.col(b).alias(f"_k_{b}") for b in by]).agg(F.min(F.when(over, F.col("_n"))).alias("_first"))
    joined = out.join(firsts, [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by])
    n, first = F.col("_n"), F.col("_first")
    packed = (
        F.when(F.col(tokens).isNull(), F.lit("included"))
        .when(first.isNull() | (n < first), F.lit("included"))
        .when((n == first) & (F.col("_c") < available), F.lit("truncated"))
        .when((n > first) & (need == 0) & F.lit(available >= 0), F.lit("included"))
        .otherwise(F.lit("omitted"))
    )
    return joined.withColumn("packed", packed).select(
        *files.columns, "packed",
        F.when(F.col("packed") == "truncated", (F.lit(available) - F.col("_c")) * K.CHARS_PER_TOKEN).alias("keep_chars"),
    )


def pack_notes(packed: DataFrame, by: list[str]) -> DataFrame:
    """Files per outcome of each group."""
    return packed.groupBy(*by).agg(
        F.count_if(F.col("packed") != "omitted").alias("n_included"),
        F.count_if(F.col("packed") == "omitted").alias("n_omitted"),
    )


def trim_by_rank(symbols: DataFrame, by: list[str], order: list[Column | str], max_tokens: int,
                 tokens: str = "tokens") -> DataFrame:
    """Symbols of highest rank whose tokens together stay within the budget."""
    out = running_totals(symbols, by, order, {"_c": F.col(tokens)})
    return out.filter(F.col("_c") + F.col(tokens) <= max_tokens).select(*symbols.columns)


# What a code map gives up, in this order: ranked symbols one by one, then whole kinds, then small modules, then modules one by one.
_STAGES = {"symbol": 1, "private_method": 2, "constant": 3, "import": 4}
_SMALL_MODULES, _MODULES = 5, 6


def trim_in_stages(items: DataFrame, budgets: DataFrame, by: list[str], small_lines: int = 20) -> DataFrame:
    """``items`` with ``stage`` (in which they would go) and ``kept``, so that each group fits its ``max_tokens``.

    ``items`` has (kind, module, name, rank, tokens, module_lines, module_rank), ``budgets`` one row per group. What goes
    at once is a unit: a symbol (lowest rank first), all private methods, all constants, all imports, what is left of
    modules under ``small_lines`` lines, then what is left of a module (lowest rank first). A unit goes just when the units
    before it leave too much, so one running total over the units decides every stage of every group without a loop.
    """
    small = F.when(F.col("module_lines") < small_lines, _SMALL_MODULES).otherwise(_MODULES)
    stage = reduce(lambda rest, k: F.when(F.col("kind") == k, _STAGES[k]).otherwise(rest), _STAGES, small)
    marked = items.withColumn("stage", stage).withColumns({
        "_rank": F.when(F.col("stage") == 1, F.col("rank")).when(F.col("stage") == _MODULES, F.col("module_rank")).otherwise(F.lit(0.0)),
        "_module": F.when(F.col("stage").isin(1, _MODULES), F.col("module")).otherwise(F.lit("")),
        "_name": F.when(F.col("stage") == 1, F.col("name")).otherwise(F.lit(""))})
    unit = ["stage", "_rank", "_module", "_name"]
    units = marked.groupBy(*by, *unit).agg(F.sum("tokens").alias("_tokens"))
    totals = units.groupBy(*by).agg(F.sum("_tokens").alias("_total"))
    before = running_totals(units, by, unit, {"_before": F.col("_tokens")})
    limits = totals.join(budgets.select(*by, "max_tokens"), by).select(*by, (F.col("_total") - F.col("max_tokens")).alias("_excess"))
    decided = before.join(limits, by).select(*by, *unit, (F.col("_before") >= F.col("_excess")).alias("kept"))
    return marked.join(decided, [*by, *unit]).select(*items.columns, "stage", "kept")
