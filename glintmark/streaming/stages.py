"""Resumable stages: a finished stage is read, a missing one is run, a damaged one is an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from glintmark.session import exists


class Stages:
    """Stage tables below one folder. Spark's commit marker tells a finished stage from a broken off one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def done(self, name: str) -> bool:
        return exists(self.spark, f"{self._path(name)}/_SUCCESS")

    def run(self, name: str, build: Callable[[], DataFrame], schema: StructType | None = None) -> DataFrame:
        """Result of the stage; ``build`` is only called when there is no finished one."""
        if not self.done(name):
            build().write.mode("overwrite").parquet(self._path(name))
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(self._path(name))

    def completed(self, names: list[str]) -> list[str]:
        return [n for n in names if self.done(n)]
