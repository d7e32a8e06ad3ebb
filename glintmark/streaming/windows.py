"""Event-time windows behind a gate that sets late events aside, so that every event is counted once or listed as late.

Spark's stateful operators drop late rows without a trace. The gate takes that decision first, by the same rule, and writes
both sides down; the windows then read what passed and drop nothing more. State is bounded by the watermark: it holds open
windows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintmark.session import exists


class LateGate:
    """Splits each micro-batch: events newer than the watermark pass, the others are set aside.

    The watermark of a batch is the newest event of all batches before it less ``late``. It is one row per batch, the
    only state. A batch that is repeated after a failure is split by the same watermark; what it has
    written completely is left as it is, so that readers of ``passed`` never see an event twice. Rows without a time are late.
    """

    def __init__(self, spark: SparkSession, path: str, late: str, time: str = "ts"):
        self.spark, self.path, self.late, self.time = spark, path, late, time

    def _write(self, df: DataFrame, side: str, batch: int) -> None:
        folder = f"{self.path}/{side}/batch={batch}"
        if not exists(self.spark, f"{folder}/_SUCCESS"):
            df.write.mode("overwrite").parquet(folder)

    def _newest(self, batch: int, kind: T.DataType) -> DataFrame:
        schema = T.StructType([T.StructField("newest", kind)])
        if batch < 0:
            return self.spark.createDataFrame([(None,)], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/clock/batch={batch}")

    def __call__(self, df: DataFrame, batch: int) -> None:
        time = F.col(self.time)
        newest = self._newest(batch - 1, df.schema[self.time].dataType)
        mark = newest.select(F.col("newest") - F.expr(f"INTERVAL {self.late}")).scalar()
        on_time = time.isNotNull() & F.coalesce(time > mark, F.lit(True))
        self._write(df.filter(on_time), "passed", batch)
        self._write(df.filter(~on_time).withColumn("watermark", mark), "late", batch)
        now = df.agg(F.max(time).alias("newest"))
        self._write(newest.unionByName(now).agg(F.max("newest").alias("newest")).coalesce(1), "clock", batch)

    def watermarks(self) -> DataFrame:
        """``batch`` and the ``watermark`` by which it was split, null for the first one."""
        clock = self.spark.read.parquet(f"{self.path}/clock")
        before = clock.select((F.col("batch") + 1).alias("batch"), (F.col("newest") - F.expr(f"INTERVAL {self.late}")).alias("watermark"))
        return clock.select("batch").join(before, "batch", "left")

    def passed(self, schema: T.StructType) -> DataFrame:
        """What passed, as a stream of its own."""
        return self.spark.readStream.schema(schema).parquet(f"{self.path}/passed")

    def late_rows(self) -> DataFrame:
        """What was set aside, with its ``batch`` and the ``watermark`` that it was behind."""
        return self.spark.read.parquet(f"{self.path}/late")


def sliding_counts(events: DataFrame, late: str, width: str, slide: str, by: list[str], time: str = "ts") -> DataFrame:
    """Events per ``by`` and window of ``width`` that begins every ``slide``; in append mode a window is reported once it is closed."""
    return (
        events.withWatermark(time, late).groupBy(F.window(time, width, slide), *by).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n")
    )


def session_counts(events: DataFrame, late: str, gap: str, by: list[str], time: str = "ts", **more: Column) -> DataFrame:
    """Sessions per ``by``: runs of events less than ``gap`` apart, with their number ``n`` and the aggregates ``more``.

    A session ends ``gap`` after its last event and is reported once the watermark has passed its end. A task merges the
    sessions of its own rows before the shuffle where Spark's ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``
    is set, which keeps a busy key from sending every row.
    """
    return (
        events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by)
        .agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in more.items()])
        .select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, "n", *more)
    )
