"""Exact dedup as a stateful stream: keyed state on disk keeps, for each digest and without expiry, the first
document's stable identifier and the place of its content; when a digest comes again the full bytes decide."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.shared import BROADCAST_ROWS, Work, delete, exists, fresh, tidy, with_ids, work_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bytes of a row that names a file, as it lies in memory.
WIDTH = 200
PLACE = "number long, doc_id long, file string, row long"
PRINT = f"digest binary, {PLACE}"


def md5(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _roots(docs: DataFrame) -> list[str]:
    """The paths that docs was read from, if its text and doc_id are columns of Parquet files as they are, else none."""
    plan = docs.select("text", "doc_id")._jdf.queryExecution().analyzed()
    leaves, out = plan.collectLeaves(), plan.output()
    if leaves.size() != 1 or not leaves.apply(0).getClass().getSimpleName() == "LogicalRelation":
        return []
    relation = leaves.apply(0).relation()
    if not relation.getClass().getSimpleName() == "HadoopFsRelation" or relation.fileFormat().getClass().getSimpleName() != "ParquetFileFormat":
        return []
    columns = leaves.apply(0).output()
    held = {columns.apply(i).exprId().toString(): columns.apply(i).name() for i in range(columns.size())}
    if [held.get(out.apply(i).exprId().toString()) for i in range(2)] != ["text", "doc_id"]:
        return []
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:  # something on the way, a join say, has lost where a row stands
        return []
    paths = relation.location().rootPaths()
    return [paths.apply(i).toString() for i in range(paths.size())]


def _placed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


class ExactDedup:
    """A stream of batches of documents(doc_id, text, ...) whose state lives in `state` (a folder of the shared file system).

    The state holds, of the first document of each digest, its batch, doc_id, file and row there; `variants` holds the same of
    texts whose digest another text had before. `digest` may be any function of the text: equal digests only make candidates,
    equal bytes make copies, so a weak one costs time, never a document. Files that batches were read from have to stay as they
    are; a batch that isn't read from Parquet as it is gets its texts written to the state's folder, and is found there.

    A batch that is taken in again under its name, after a failure or to no purpose, gives the same rows as before."""

    def __init__(self, spark: SparkSession, state: str | None = None, digest=md5) -> None:
        self.spark, self.digest = spark, digest
        self.state = state or work_dir(spark, "exact-dedup")

    def _stream(self, updates: str) -> None:
        """Takes new fingerprints into the state; what it says of the digests of this batch goes to `updates`."""
        spark = self.spark
        first = F.min(F.struct("number", F.col("doc_id").isNull().alias("nameless"), "doc_id", "file", "row"))
        held = spark.readStream.schema(PRINT).option("recursiveFileLookup", "true").parquet(f"{self.state}/inbox").groupBy("digest").agg(first.alias("first"), F.count("*").alias("n"))
        provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        try:
            # a micro-batch that runs again overwrites its own folder, so nothing counts twice
            write = held.writeStream.outputMode("update").option("checkpointLocation", f"{self.state}/stream").trigger(availableNow=True)
            write.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{updates}/micro={i}")).start().awaitTermination()
        finally:
            if provider is None:
                spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
            else:
                spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)

    def _register(self, docs: DataFrame, name: str) -> tuple[int, DataFrame, dict[int, list[str]]]:
        """The batch's number, its rows with their places, and the paths of all batches; a row for each batch is all that the driver gets."""
        spark, folder = self.spark, f"{self.state}/batches"
        known = spark.read.parquet(f"{folder}/*").collect() if exists(spark, folder) else []
        roots = {r.number: r.roots for r in known}
        for r in known:
            if r.name == name:
                return r.number, _placed(spark.read.parquet(*r.roots)), roots
        number = max(roots, default=-1) + 1
        paths = _roots(docs)
        if paths:
            placed = _placed(docs)
        else:
            paths = [f"{self.state}/content/{number}"]
            docs.select("doc_id", "text").where("text is not null").write.mode("overwrite").parquet(paths[0])
            placed = _placed(spark.read.parquet(*paths))
        placed.where("text is not null").select(self.digest(F.col("text")).alias("digest"), F.lit(number).cast("long").alias("number"), "doc_id", "file", "row").write.mode("overwrite").parquet(f"{self.state}/inbox/{number}")
        # the last step: before it the batch isn't known, and all of it is done again
        spark.createDataFrame([(name, number, paths)], "name string, number long, roots array<string>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{number}")
        return number, placed, roots | {number: paths}

    def copies(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Takes one batch in: (doc_id, duplicate_of, print) of rows that repeat an earlier text byte for byte; print is the text's SHA-256.

        duplicate_of is the first holder of the text: that of the earliest batch, in it the smallest doc_id (null last). batch names
        the batch; one that is taken in again under its name gives the rows that it gave. Without a name each call is a batch of its own."""
        with tidy(self.spark):
            return self._copies(docs, batch or uuid.uuid4().hex)

    def _copies(self, docs: DataFrame, batch: str) -> DataFrame:
        spark = self.spark
        number, placed, roots = self._register(docs, batch)
        updates, work = f"{self.state}/updates/{number}", Work(spark, root=f"{self.state}/work/{uuid.uuid4().hex}")
        self._stream(updates)
        again = spark.read.schema(PRINT).parquet(f"{self.state}/inbox/{number}")
        seen = Window.partitionBy("digest").orderBy(F.col("n").desc())
        if not exists(spark, updates):  # a batch without a text
            return spark.createDataFrame([], "doc_id long, duplicate_of long, print binary")
        told = spark.read.parquet(updates).where("n > 1").withColumn("k", F.row_number().over(seen)).where("k = 1").select("digest", "first")
        hits = work.keep("hits", again.join(told, "digest"))  # rows whose digest has come before, in this batch or another
        mine = with_ids(placed.where("text is not null"), hits.select("file", "row"), "left_semi", ["file", "row"], size=WIDTH * hits.count())
        mine = mine.select(self.digest(F.col("text")).alias("digest"), "text", F.lit(number).cast("long").alias("number"), "doc_id", "file", "row")
        elders = hits.where(F.col("first.number") < number).select("digest", *[F.col(f"first.{c}").alias(c) for c in ("number", "doc_id", "file", "row")]).distinct()
        if exists(spark, f"{self.state}/variants"):
            others = spark.read.schema(PRINT).option("recursiveFileLookup", "true").parquet(f"{self.state}/variants").where(F.col("number") < number)
            elders = elders.unionByName(others.join(hits.select("digest").distinct(), "digest", "left_semi"))
        elders = work.keep("elders", elders)
        paths = sorted({p for r in elders.select("number").distinct().collect() for p in roots[r.number]})  # one row for each batch
        if paths:
            old = _placed(spark.read.parquet(*paths)).select("text", "file", "row")
            mine = mine.unionByName(with_ids(old, elders, "inner", ["file", "row"], size=WIDTH * elders.count()).select(*mine.columns))
        # the bytes decide: only rows of one digest and one text are copies of each other
        text = Window.partitionBy("digest", "text").orderBy("number", F.col("doc_id").asc_nulls_last(), "file", "row")
        ranked = mine.select("*", F.first("doc_id").over(text).alias("duplicate_of"), F.row_number().over(text).alias("k")).where(F.col("number") == number)
        found = work.keep("found", ranked.select(*PRINT_COLUMNS, "duplicate_of", "k", F.unhex(F.sha2("text", 256)).alias("print")))
        # a text that is new, but whose digest the state knows for another one
        new = found.where("k = 1").select(*PRINT_COLUMNS).join(told.select("digest", "first.number", "first.file", "first.row"), ["digest", "number", "file", "row"], "left_anti")
        new.write.mode("overwrite").parquet(f"{self.state}/variants/{number}")
        return found.where("k > 1").select("doc_id", "duplicate_of", "print")


PRINT_COLUMNS = ["digest", "number", "doc_id", "file", "row"]


def exact_copies(docs: DataFrame, digest=md5) -> DataFrame:
    """(doc_id, duplicate_of) for each row of documents whose text, byte for byte, an earlier row has.

    The first holder is the row of the smallest doc_id (null last). Null texts are nobody's copies; empty texts
    are equal to each other; a row that repeats doc_id and text is a copy of itself (doc_id = duplicate_of);
    rows of null doc_id can be copies, with doc_id null. doc_id is cast to long, so it has to be a number. An empty table
    gives no rows; other columns are ignored; texts of any length are compared whole."""
    return ExactDedup(docs.sparkSession, digest=digest).copies(docs).select("doc_id", "duplicate_of")


def without_copies(docs: DataFrame, digest=md5) -> DataFrame:
    """documents, all columns, with one row for each text: the first by doc_id (null last), then by the other columns.

    Rows of null text all stay; columns of any name are kept as they are."""
    dropped = ExactDedup(docs.sparkSession, digest=digest).copies(docs)
    key, mark = fresh(docs, "doc", "print")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not dropped.where("doc_id is null or duplicate_of = doc_id").limit(1).count():
        # doc_id and text name one row: a narrow anti join does
        gone = dropped.select(F.col("doc_id").alias(key), F.col("print").alias(mark)).distinct()
        keyed = docs.withColumns({key: F.col("doc_id").cast("long"), mark: F.unhex(F.sha2("text", 256))})
        n = gone.count()
        side = F.broadcast(gone) if n <= BROADCAST_ROWS // 2 else gone.hint("shuffle_hash")
        return keyed.join(side, [key, mark], "left_anti").select(*columns)
    # a row repeats whole or has no doc_id: the rows of each text are numbered themselves
    others = [F.col(f"`{c}`") for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind and "variant" not in kind]  # what has an order
    order = Window.partitionBy("text").orderBy(F.col("doc_id").asc_nulls_last(), *others)
    numbered = docs.where("text is not null").withColumn(mark, F.row_number().over(order)).where(F.col(mark) == 1)
    return numbered.select(*columns).unionByName(docs.where("text is null"))


ORACLE = """
SELECT doc_id, duplicate_of FROM (
  SELECT doc_id, first_value(doc_id) OVER w AS duplicate_of, row_number() OVER w AS k
  FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS LAST))
WHERE k > 1
"""
