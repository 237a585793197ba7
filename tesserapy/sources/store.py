"""A folder of named Parquet tables, with tables computed only if absent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("samples", "districts", "plans", "distributions", "distance_edges", "distances", "linkage")


class Store:
    """Tables under a root, in any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        if name not in TABLES:
            raise KeyError(name)
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def has(self, name: str) -> bool:
        """A table counts once its writer has finished."""
        fs, where = self._fs(f"{self.path(name)}/_SUCCESS")
        return bool(fs.exists(where))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def ensure(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stored table; made and stored first if it is absent."""
        return self.read(name) if self.has(name) else self.write(name, make())

    def drop(self, name: str) -> None:
        """Delete one table."""
        fs, where = self._fs(self.path(name))
        fs.delete(where, True)

    def clean(self) -> None:
        """Delete the tables and leave an empty folder."""
        fs, where = self._fs(self.root)
        fs.delete(where, True)
        fs.mkdirs(where)
