"""Files as rows: decoding, identity, validation, cached page texts, and which pages are still to do."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import Config
from lodestar.functions.text import document_name, lines, strip


BINARY = "path string, modificationTime timestamp, length long, content binary"


def read_binary(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = False, empty: bool = False) -> DataFrame:
    """path, modificationTime, length, content; the content column is only read where it is used.

    Spark lists no empty files. With `empty` the driver looks for them itself, file by file: for folders that someone put together, not for a lake."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    rows = _empty_files(spark, path, pattern, recursive) if empty else []
    return found.unionByName(spark.createDataFrame(rows, found.schema)) if rows else found


def _empty_files(spark: SparkSession, path: str, pattern: str | None, recursive: bool) -> list[tuple]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for top in system.globStatus(at) or []:
        below = system.listFiles(top.getPath(), recursive)
        while below.hasNext():
            file = below.next()
            name = file.getPath().getName()
            if file.getLen() == 0 and name[0] not in "._" and (pattern is None or fnmatch(name, pattern)):
                out.append((file.getPath().toString(), datetime.fromtimestamp(file.getModificationTime() / 1000), 0, b""))
    return out


def decode(content: Column) -> Column:
    """Text of bytes: UTF-8, else GBK, else GB18030, else UTF-8 with replacement marks; line ends as \\n, a byte order mark stays."""

    def text(data: bytes) -> str:
        for name in ("utf-8", "gbk", "gb18030"):
            try:
                return data.decode(name)
            except UnicodeDecodeError:
                continue
        return data.decode("utf-8", "replace")

    def batches(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in it:
            yield batch.map(lambda d: None if d is None else text(bytes(d)))

    return F.regexp_replace(F.pandas_udf(batches, "string")(content), "\r\n|\r", "\n")


def problem(name: Column, length: Column, head: Column, config: Config = Config()) -> Column:
    """The first thing wrong with a file, or null: missing, bad_type, empty, too_large, bad_header."""
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(length.isNull(), F.lit("missing")).when(~kind.isin("pdf", "txt"), F.lit("bad_type")).when(length == 0, F.lit("empty")).when(length > config.max_file_bytes, F.lit("too_large")).when((kind == "pdf") & (F.coalesce(head, F.lit(b"")) != F.lit(b"%PDF-")), F.lit("bad_header"))


def catalogued(files: DataFrame, config: Config = Config()) -> DataFrame:
    """Files of read_binary() with file_md5, file_name, file_size, doc_name and problem."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.md5("content").alias("file_md5"), name.alias("file_name"), F.col("length").alias("file_size"), document_name(F.col("path")).alias("doc_name"), problem(name, F.col("length"), F.substring("content", 1, 5), config).alias("problem"), "content")


def texts(files: DataFrame) -> DataFrame:
    """Valid text files as documents(doc_id, doc_name, text)."""
    return files.where(F.col("problem").isNull() & F.lower("file_name").endswith(".txt")).select(F.col("file_md5").alias("doc_id"), "doc_name", decode(F.col("content")).alias("text"))


def unseen(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files, one for each MD5, that the catalog hasn't."""
    return files.dropDuplicates(["file_md5"]).join(catalog.select("file_md5"), "file_md5", "left_anti")


def text_layer(text: Column) -> Column:
    """A page's own text: its lines stripped, blank ones dropped."""
    return F.array_join(F.filter(F.transform(lines(text), strip), lambda x: x != ""), "\n")


def cached_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages (page from 1, text) of the newest run in a cache folder: <folder>/<run>/<n>.md, runs by name, pages by the first number in the file name."""
    found = read_binary(spark, f"{folder}/*", "*.md", empty=True)  # a blank page is an empty file
    parts = F.split("path", "/")
    rows = found.select(F.element_at(parts, -2).alias("run"), F.regexp_extract(F.element_at(parts, -1), r"(\d+)", 1).cast("int").alias("n"), F.element_at(parts, -1).alias("name"), "content")
    newest = rows.agg(F.max("run").alias("run"))
    mine = rows.join(F.broadcast(newest), "run", "left_semi")  # one row
    from pyspark.sql.window import Window

    return mine.select(F.row_number().over(Window.partitionBy("run").orderBy("n", "name")).alias("page"), decode(F.col("content")).alias("text"))


def write_cache(pages: DataFrame, folder: str, run: str) -> None:
    """Pages(doc_id, page, text) as one file each, named by the page, in a folder of the run: each row is written by the task that holds it."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.makedirs(f"{folder}/{run}", exist_ok=True)
        for pdf in batches:
            for page, text in zip(pdf["page"], pdf["text"]):
                with open(f"{folder}/{run}/{page}.md", "w", encoding="utf-8") as out:
                    out.write(text or "")
            yield pdf[["page"]]

    pages.mapInPandas(write, "page int").count()


def pages_to_do(wanted: DataFrame, written: DataFrame) -> DataFrame:
    """Pages (doc_id, page) that haven't been written; a run that stopped goes on with them."""
    return wanted.join(written.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")


def in_bounds(wanted: list[int], total: int) -> list[int]:
    """Pages asked for that the document has, in order."""
    return sorted({p for p in wanted if 1 <= p <= total})


def preview(text: Column, keep: int = 3, width: int = 150) -> Column:
    """The first lines of a chunk after its summary and header marks, cut at `width`."""
    body = F.filter(lines(text), lambda x: ~(F.startswith(x, F.lit("[概述]")) | F.startswith(x, F.lit("[表头]"))))
    short = F.array_join(F.slice(body, 1, keep), "\n")
    return F.when(F.length(short) > width, F.concat(F.left(short, F.lit(width)), F.lit("..."))).otherwise(short)


def folder_size(spark: SparkSession, *folders: str) -> int:
    """Bytes of all files in the folders; -1 if one isn't there. Contents aren't read."""
    total = 0
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return -1
        total += fs.getContentSummary(path).getLength()
    return total
