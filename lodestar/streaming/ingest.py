"""Continuous ingest: new text files are chunked as they come and appended once, keyed by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.config import Config
from lodestar.operators.chunking import chunk_texts
from lodestar.sources.files import BINARY, decode


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    """documents(doc_id, doc_name, text) of text files as they appear, one row each."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.txt").load(folder)
    return files.select(F.md5("content").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("doc_name"), decode(F.col("content")).alias("text"))


def ingest(docs: DataFrame, chunks_path: str, checkpoint: str, config: Config = Config(), separator: str = "\n\n") -> StreamingQuery:
    """Starts a query that takes what is there and ends: chunks of documents that the folder hasn't yet are appended to it.

    Documents are known by doc_id, so a file that comes again, or a micro-batch that runs again, adds nothing."""
    spark = docs.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(["doc_id"])
        try:
            fresh = fresh.join(spark.read.parquet(chunks_path).select("doc_id").distinct(), "doc_id", "left_anti")
        except Exception as error:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(error):
                raise
        chunk_texts(fresh, config, separator).write.mode("append").parquet(chunks_path)

    return docs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Operations by kind in tumbling windows, with a watermark: events(ts, event_type) -> start, event_type, n."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")
