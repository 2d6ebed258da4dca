"""Shared results as named files, which outlive the session that made them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class ResultStore:
    """Results of one analysis as parquet under a folder that the caller gives and all executors share.

    A result counts once it is written whole, so a run that broke off takes up where it was when
    it starts again with the same folder, sources and window. The owner removes the folder.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        return self._files.exists(self._path(f"{self.folder}/{name}/_SUCCESS"))

    def get(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.folder}/{name}") if self.has(name) else None

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """The stored result of this name; ``df`` is computed if there is none."""
        path = f"{self.folder}/{name}"
        if not self.has(name):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def names(self) -> list[str]:
        """The results that are whole."""
        if not self._files.exists(self._path(self.folder)):
            return []
        found = (entry.getPath().getName() for entry in self._files.listStatus(self._path(self.folder)))
        return sorted(name for name in found if self.has(name))

    def remove(self) -> None:
        """Delete all results."""
        self._files.delete(self._path(self.folder), True)
