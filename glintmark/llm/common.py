"""Small helpers shared by the operators: column choice, batches, folders."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG = 2**63


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the whole text alone, null text as empty; every other column is left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Short slices of Arrow batches, so that Python objects of a few hundred texts exist at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def signed(value: int) -> int:
    """An unsigned 64-bit number as Spark's long."""
    return value - 2 * LONG if value >= LONG else value


def chosen(df: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """The ``n`` rows with about the smallest hashes of their id, or all if there are no more.

    A share of the ids of about twice the size is cut out by another part of the hash first, so what the tasks send to
    the one that sorts does not grow with their number.
    """
    total, low = df.count(), 1 << 40
    if total > 4 * n:
        df = df.filter(F.pmod(F.xxhash64(F.lit(1), id_col), F.lit(low)) < 2 * n * low // total)
    return df.orderBy(F.xxhash64(id_col), id_col).limit(n)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
