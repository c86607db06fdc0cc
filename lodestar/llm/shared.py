"""What the operators share: the shared folder, and joins whose broadcast side has a checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one or two integers that may be broadcast; 2 million take about 60 MB. Beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Bytes of wider rows that may be broadcast, as they lie in memory.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches: spark.checkpoint.dir; a temporary one only where that is unset and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that this process has named, in order.
_made: list[str] = []


def work_dir(spark: SparkSession, what: str) -> str:
    _made.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


def made_so_far() -> int:
    return len(_made)


def drop_since(spark: SparkSession, mark: int) -> None:
    """Deletes the folders named since made_so_far() said `mark`; for when all that was made of them is written elsewhere."""
    for path in _made[mark:]:
        delete(spark, path)
    del _made[mark:]


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _file(spark, path)
    return system.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    system, where = _file(spark, path)
    system.delete(where, True)


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that no lost executor makes it run again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Makes Spark delete the shuffle files of a query once it has ended; a lost executor still finds them while it runs.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The most rows of a batch that goes to Python at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def tidy(spark: SparkSession, batch: int | None = None) -> Iterator[None]:
    """Queries that begin in here leave no shuffle files behind, and send Python so many rows at once at most, if `batch` is given."""
    wanted = {CLEAN: "true"} | ({BATCH: str(batch)} if batch else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


class Work:
    """Tables that an operator writes to the shared folder, to be read several times, and drops when they are used up."""

    def __init__(self, spark: SparkSession, what: str = "work", root: str | None = None, batch: int | None = None) -> None:
        self.spark, self.root, self.batch = spark, root or work_dir(spark, what), batch

    def keep(self, name: str, df: DataFrame, *by: str) -> DataFrame:
        """df, computed once and written, in folders by the columns `by`; no lost executor makes it run again, and its shuffle files go at once."""
        with tidy(self.spark, self.batch):
            df.write.partitionBy(*by).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it unlike df's columns, however they are written."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def with_ids(docs: DataFrame, ids: DataFrame, how: str, key: str | list[str] = "doc_id", n: int | None = None, size: int | None = None) -> DataFrame:
    """docs joined to the narrow table `ids` on `key`.

    `ids` is counted first (n, if it isn't known): up to BROADCAST_ROWS it is broadcast, so that texts stay where they are; beyond that both
    sides are hash-partitioned and the narrow one is the build side. size: bytes of the table, if its rows aren't narrow, of
    which BROADCAST_BYTES are broadcast."""
    if size is not None:
        small = size <= BROADCAST_BYTES
    else:
        small = (ids.count() if n is None else n) <= BROADCAST_ROWS
    side = F.broadcast(ids) if small else ids.hint("shuffle_hash")
    return docs.join(side, key, how)


def with_lists(docs: DataFrame, lists: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs joined to a table of lists by `key`, which grows as fast as the texts do: both sides are shuffled at every size, so one plan is all there is."""
    return docs.join(lists.hint("shuffle_hash"), key)


def lists_size(lists: DataFrame, column: str, width: int) -> int:
    """Bytes in memory of a table of a doc_id and a list of elements of `width` bytes."""
    n, total = lists.agg(F.count("*"), F.coalesce(F.sum(F.size(column)), F.lit(0))).first()
    return 64 * n + width * total
