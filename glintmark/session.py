"""Session settings and the shared folder that iterative jobs write to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "findings", master: str | None = None, shuffle: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; ``master`` is left to spark-submit when absent."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_KEY} to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="glintmark-")
        spark.conf.set(_CHECKPOINT_KEY, configured)
    return configured.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly below a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that a job of this library wrote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables one iterative job writes, so that lineage stays short and lost executors cost a re-read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = shared_path(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Remove one table this job wrote and no longer reads."""
        remove(self.spark, self.path(name))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage."""
    return Scratch(df.sparkSession, name).save(df, "t")


_BROADCAST_KEYS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@contextmanager
def small_broadcasts(spark: SparkSession, most: str = "256k") -> Iterator[None]:
    """Jobs run inside broadcast a join side by themselves only up to ``most``; a lower setting of the session stays.

    The driver builds what is broadcast, as a table several times the size of its rows, and keeps it until its garbage is
    collected. A job of many joins would fill it with sides that each look small. For steps that run all their joins inside.
    """
    to_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    before = {key: spark.conf.get(key, None) for key in _BROADCAST_KEYS}
    try:
        for key, value in before.items():
            if value is not None and not value.startswith("-") and to_bytes(value) > to_bytes(most):  # below zero: none
                spark.conf.set(key, most)
        yield
    finally:
        for key, value in before.items():
            if value is not None:
                spark.conf.set(key, value)


ROWS_A_TASK = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to a task for every ``ROWS_A_TASK`` of ``rows``, so that a task's memory does not grow with the table.

    Shuffles have a fixed number of partitions and adaptive execution merges them, so their tasks grow. What is grouped or joined
    by these keys afterwards stays in its task. Tables too small for more tasks than there are cores are left to the shuffles.
    """
    spark = df.sparkSession
    tasks = -(-rows // ROWS_A_TASK)
    if tasks <= min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))):
        return df
    return df.repartition(tasks, *keys)
