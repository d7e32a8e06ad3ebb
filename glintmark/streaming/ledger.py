"""Event ledger as a stream: counts, event-time windows, budget guard, first-seen state, snapshots.

Every sink writes a folder per micro-batch and overwrites it on replay, so a batch that is repeated after
a failure leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintmark.operators.history import first_places, first_seen
from glintmark.operators.prefix import running_totals
from glintmark.session import Scratch, exists, folders, remove, shared_path
from glintmark.sources.ledger import parse_events

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ledger_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New ledger lines below ``path`` as (ts, kind, run_id, fields)."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return parse_events(reader.load(path))


def kind_counts(events: DataFrame) -> DataFrame:
    """Events per kind so far."""
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per kind and window. A watermark bounds the state: what comes more than ``late`` behind the newest event is dropped.

    In append mode a window is reported once it is closed; in update mode, read through ``latest_rows``, open
    windows are reported too.
    """
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "kind", "n")
    )


def run_to_end(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], name: str, mode: str = "append",
               checkpoint: str | None = None) -> None:
    """Process all available input, then stop."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint or shared_path(stream.sparkSession, f"{name}-checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def overwrite_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to a folder of its own."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def snapshot_batches(path: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """Write the full result after each micro-batch as a version of its own, name it in a pointer, and remove old versions.

    The pointer is written when its version is complete, so a reader never meets a half-written one. The last ``keep``
    versions stay, so that a reader which has just read the pointer can finish; the folder does not grow with the batches.
    """

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{path}/version={batch}")
        spark.createDataFrame([(batch,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/pointer={batch}")
        for kind in ("pointer", "version"):
            for name in folders(spark, path):
                if name.startswith(f"{kind}=") and int(name.split("=")[1]) <= batch - keep:
                    remove(spark, f"{path}/{name}")

    return write


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The version that the newest complete pointer names."""
    done = [int(name.split("=")[1]) for name in folders(spark, path) if name.startswith("pointer=") and exists(spark, f"{path}/{name}/_SUCCESS")]
    if not done:
        raise FileNotFoundError(f"no complete snapshot below {path}")
    return spark.read.parquet(f"{path}/version={max(done)}")


def latest_rows(spark: SparkSession, path: str, keys: list[str], value: str) -> DataFrame:
    """The last value that any batch wrote for each key: the state of an update-mode stream."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


class BudgetGuard:
    """Marks each call with the spend before it and whether it may run, across micro-batches.

    The spend per run is kept as a table per batch. Inside a batch running totals are computed slice by
    slice, so one busy run does not meet in one task.
    """

    def __init__(self, spark: SparkSession, path: str, limit: float, by: str, order: list[str],
                 slice_by: Column | None = None):
        self.spark, self.path, self.limit, self.by, self.order, self.slice_by = spark, path, limit, by, order, slice_by

    def _spent(self, batch: int, schema: T.StructType) -> DataFrame:
        if batch == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/spent/batch={batch - 1}")

    def __call__(self, df: DataFrame, batch: int) -> None:
        money = df.schema["cost_usd"].dataType
        schema = T.StructType([df.schema[self.by], T.StructField("spent", money)])
        spent = self._spent(batch, schema)
        df = df.persist()
        rows = running_totals(df, [self.by], self.order, {"_before": F.col("cost_usd")}, self.slice_by)
        rows = rows.join(spent, self.by, "left")
        before = (F.coalesce("spent", F.lit(0).cast(money)) + F.col("_before")).cast(money)
        allowed = (before < F.lit(self.limit).cast(money)) | F.lit(self.limit <= 0)
        rows.select(*df.columns, before.alias("spent_before"), allowed.alias("allowed")).write.mode("overwrite").parquet(
            f"{self.path}/calls/batch={batch}")
        now = df.groupBy(self.by).agg(F.sum("cost_usd").cast(money).alias("spent"))
        spent.unionByName(now).groupBy(self.by).agg(F.sum("spent").cast(money).alias("spent")).write.mode("overwrite").parquet(
            f"{self.path}/spent/batch={batch}")
        df.unpersist()

    def result(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/calls").drop("batch")


class SeenTracker:
    """Adds ``status`` (new or recurring) and ``first_seen_run`` over the whole life of a stream.

    What was seen is keyed state of a stream inside the stream: each batch puts one row per fingerprint to it, found by
    aggregation with a map-side step, and gets one row per fingerprint back, with the batch and the run that saw it first.
    A batch's first rows are found and written once, to ask for them and to mark the others.
    The state lives in Spark's on-disk store, which looks up the keys of the batch alone, so what a batch reads
    depends on the batch and not on what came before. The store grows with the fingerprints, as tracking asks for.

    A batch that is repeated finds its question and its answer where the first try got that far; the inner stream
    answers what is still open. Questions and answers of older batches are removed.
    """

    def __init__(self, spark: SparkSession, path: str, order: list[str]):
        self.spark, self.path, self.order = spark, path, order

    def _ask(self, firsts: DataFrame, batch: int) -> None:
        folder = f"{self.path}/asked/batch={batch}"
        if not exists(self.spark, f"{folder}/_SUCCESS"):
            firsts.select("fingerprint", F.col("first_seen_run").alias("run")).write.mode("overwrite").parquet(folder)

    def _answer(self, fingerprint: T.StructField, run: T.StructField) -> None:
        """Let the inner stream take in what was asked and write, per fingerprint of it, who saw it first."""
        schema = T.StructType([fingerprint, T.StructField("run", run.dataType), T.StructField("batch", T.IntegerType())])
        asked = self.spark.readStream.schema(schema).parquet(f"{self.path}/asked")
        seen = asked.groupBy("fingerprint").agg(F.min(F.struct("batch", "run")).alias("first"), F.max("batch").alias("batch"))

        def write(df: DataFrame, turn: int) -> None:
            df.select("fingerprint", F.col("first.batch").alias("first_batch"), F.col("first.run").alias("first_run"), "batch").write.mode(
                "overwrite").partitionBy("batch").parquet(f"{self.path}/answered/turn={turn}")

        before = self.spark.conf.get(_STORE, None)
        self.spark.conf.set(_STORE, _ON_DISK)
        try:
            run_to_end(seen, write, "seen", mode="update", checkpoint=f"{self.path}/state")
        finally:
            self.spark.conf.unset(_STORE) if before is None else self.spark.conf.set(_STORE, before)

    def __call__(self, df: DataFrame, batch: int) -> None:
        scratch = Scratch(self.spark, "firsts")
        first = scratch.save(first_places(df, self.order), "t")
        marked = first_seen(df, self.order, first)
        self._ask(first.select(F.col("_fp").alias("fingerprint"), F.col("_first.r").alias("first_seen_run")), batch)
        self._answer(df.schema["fingerprint"], df.schema["run_id"])
        if exists(self.spark, f"{self.path}/answered"):  # a batch without rows asks nothing
            answers = self.spark.read.parquet(f"{self.path}/answered").filter(F.col("batch") == batch).select("fingerprint", "first_batch", "first_run")
            marked = marked.join(answers, "fingerprint").select(
                *df.columns,
                F.when(F.col("first_batch") < batch, F.col("first_run")).otherwise(F.col("first_seen_run")).alias("first_seen_run"),
                F.when(F.col("first_batch") < batch, F.lit("recurring")).otherwise(F.col("status")).alias("status"))
        marked.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        scratch.drop("t")
        remove(self.spark, f"{self.path}/asked/batch={batch - 2}")
        remove(self.spark, f"{self.path}/answered/turn={batch - 2}")

    def result(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").drop("batch")
