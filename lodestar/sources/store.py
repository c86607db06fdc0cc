"""Tables in folders, each version a folder of its own; a pointer file names the current one, so a reader sees a whole version or the one before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Scratch:
    """Tables that a plan writes once and reads several times, in a folder that all executors reach; close() drops them."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Table:
    """by: a column whose values are folders, so that a filter on it reads those only."""

    def __init__(self, spark: SparkSession, root: str, schema: str, by: str | None = None) -> None:
        self.spark, self.root, self.schema, self.by = spark, root.rstrip("/"), schema, by
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _current(self) -> str | None:
        pointer = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(pointer):
            return None
        stream = self._fs.open(pointer)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def exists(self) -> bool:
        return self._current() is not None

    def read(self) -> DataFrame:
        found = self._current()
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{found}") if found else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> None:
        """A new version; the one before stays until vacuum()."""
        name = f"v-{uuid.uuid4().hex}"
        columns = self.read().schema
        self._writer(df.select(*[F.col(f.name).cast(f.dataType) for f in columns])).parquet(f"{self.root}/{name}")
        self._point(name)

    def append(self, df: DataFrame) -> None:
        """More files in the current version: nothing that is there is written again."""
        found = self._current()
        if found is None:
            self.write(df)
        else:
            columns = self.read().schema
            self._writer(df.select(*[F.col(f.name).cast(f.dataType) for f in columns])).mode("append").parquet(f"{self.root}/{found}")

    def _writer(self, df: DataFrame):
        return df.repartition(self.by).write.partitionBy(self.by) if self.by else df.write

    def _point(self, name: str) -> None:
        stream = self._fs.create(self._path(f"{self.root}/CURRENT"), True)
        try:
            stream.write(bytearray(name.encode()))
        finally:
            stream.close()

    def vacuum(self) -> None:
        found = self._current()
        for entry in self._fs.listStatus(self._path(self.root)):
            name = entry.getPath().getName()
            if name.startswith("v-") and name != found:
                self._fs.delete(entry.getPath(), True)
