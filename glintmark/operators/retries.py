"""Work that is tried again: a queue table, one round per attempt, halved where an item was too large."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintmark.functions.responses import outcome
from glintmark.session import Scratch


def first_half(n: Column) -> Column:
    """How many files of ``n`` an overflowing item keeps: the first half, one at least."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(n / 2))


def attempt_rounds(work: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], rounds: int = 2, item: str = "item") -> DataFrame:
    """Every file of every attempt: (``item``, attempt, pos, file, n_files, outcome).

    ``work`` is the queue (item, pos from 0 without gaps, file). ``attempt`` gets the items of a round (item, n_files)
    and its number and adds error, error_type, n_findings and parse_failed. An item without an answer is queued as it is,
    one that overflows with its first half; a fatal or a completed one leaves the queue, and after the last round all do. A round is
    written before the next begins, so answers are asked for once, whatever fails later. Files stay rows, so an item may
    have any number of them.
    """
    scratch = Scratch(work.sparkSession, "rounds")
    queue = work.select(item, "pos", "file")
    done = []
    for k in range(1, rounds + 1):
        tried = attempt(queue.groupBy(item).agg(F.count(F.lit(1)).alias("n_files")), k)
        result = outcome(F.col("error"), F.col("error_type"), F.col("n_findings"), F.col("parse_failed"))
        answers = scratch.save(tried.select(item, "n_files", result.alias("outcome")), f"answers{k}")
        rows = scratch.save(queue.join(answers, item).select(item, F.lit(k).alias("attempt"), "pos", "file", "n_files", "outcome"), f"round{k}")
        done.append(rows)
        queue = rows.filter((F.col("outcome") == "retry") | (F.col("outcome") == "overflow") & (F.col("pos") < first_half(F.col("n_files")))).select(item, "pos", "file")
        if queue.isEmpty():
            break
    return reduce(DataFrame.unionAll, done)


def omitted_files(attempts: DataFrame, rounds: int, item: str = "item") -> DataFrame:
    """(item, attempt, kind, n): files that an overflow left out of the next attempt, and those of items that no attempt completed."""
    per = attempts.groupBy(item, "attempt", "outcome").agg(F.max("n_files").alias("n"))
    halved = per.filter((F.col("outcome") == "overflow") & (F.col("attempt") < rounds)).select(item, "attempt", F.lit("files_omitted").alias("kind"), (F.col("n") - first_half(F.col("n"))).alias("n"))
    failed = per.filter((F.col("outcome") == "fatal") | F.col("outcome").isin("retry", "overflow") & (F.col("attempt") == rounds))
    return halved.filter("n > 0").unionByName(failed.select(item, "attempt", F.lit("check_failed").alias("kind"), "n"))
