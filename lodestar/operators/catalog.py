"""The catalog of files, as DataFrames in and out: insert-or-ignore, updates with an audit row each, groups, counts and listings.

A function returns the new table (and the audit rows it asks for); sources.store swaps it in."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEFAULT_GROUP = "default"


def insert_ignore(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` whose key the table hasn't, one for each key (the first in the order of all columns)."""
    one = Window.partitionBy(key).orderBy(*[F.col(c) for c in sorted(new.columns) if not new.schema[c].dataType.typeName() == "map"])
    fresh = new.withColumn("_k", F.row_number().over(one)).where("_k = 1").drop("_k")
    return fresh.join(table.select(key).distinct(), key, "left_anti")


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def audit_rows(op: str, detail: Column, rows: DataFrame, result: Column | str = "success", now: datetime | None = None) -> DataFrame:
    """One audit row (without an id) for each file row."""
    at = F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp()
    got = F.lit(result) if isinstance(result, str) else result
    return rows.select(F.lit(op).alias("op_type"), detail.alias("op_detail"), "file_name", "file_md5", F.coalesce("total_chunks", F.lit(0)).cast("long").alias("chunk_count"), got.alias("op_result"), at.alias("op_time"))


def append_audit(audit: DataFrame, new: DataFrame, keep: int) -> DataFrame:
    """The audit log with new rows numbered on, and of all only the last `keep`.

    An append is a batch of operations, which is small; the numbering of it is the only ordered step."""
    start = audit.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"))
    order = Window.orderBy("op_time", "file_md5", "op_detail")
    numbered = new.crossJoin(F.broadcast(start)).select((F.col("m") + F.row_number().over(order)).cast("long").alias("id"), *new.columns)  # one row
    return rolling(audit.unionByName(numbered), keep)


def rolling(audit: DataFrame, keep: int) -> DataFrame:
    """The newest `keep` rows by id: the last id to stay is found by a top-k, and the log filtered by it, so the log isn't sorted."""
    cut = audit.select("id").orderBy(F.col("id").desc()).limit(keep).agg(F.min("id").alias("cut"))
    return audit.join(F.broadcast(cut), F.col("id") >= F.col("cut")).drop("cut")  # one row


def audit_range(audit: DataFrame, first: int | None = None, last: int | None = None, limit: int = 50) -> DataFrame:
    """With both bounds the rows between them, newest id first; else the newest by time. At most `limit`."""
    if first is not None and last is not None:
        return audit.where(F.col("id").between(first, last)).orderBy(F.col("id").desc()).limit(limit)
    return audit.orderBy(F.col("op_time").desc(), F.col("id").desc()).limit(limit)


def check_range(first: int, last: int, span: int = 50) -> str | None:
    """What is wrong with a range asked for, if anything."""
    if first > last:
        return "from > to"
    return f"span > {span}" if last - first > span else None


def latest_range(min_id: int, max_id: int, page: int = 50) -> tuple[int, int]:
    return max(min_id, max_id - page + 1), max_id


def audit_stats(audit: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return audit.agg(zero(F.min("id")).alias("min_id"), zero(F.max("id")).alias("max_id"), F.count("*").alias("total"))


def like_group(groups: Column, name: str) -> Column:
    """Whether the bar-separated list holds the group: alone byte for byte, among others without regard to ASCII case."""
    low, g = F.translate(groups, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), name.translate({c: c + 32 for c in range(65, 91)})
    return (groups == name) | F.startswith(low, F.lit(g + "|")) | F.contains(low, F.lit(f"|{g}|")) | F.endswith(low, F.lit("|" + g))


def set_group_enabled(files: DataFrame, name: str, enabled: bool) -> tuple[DataFrame, DataFrame]:
    """(files, audit rows): one row for each file of the group."""
    hit = like_group(F.col("groups"), name)
    detail = F.lit(("启用分组: " if enabled else "禁用分组: ") + name)
    return files.withColumn("is_enabled", F.when(hit, F.lit(enabled)).otherwise(F.col("is_enabled"))), audit_rows("update", detail, files.where(hit))


def set_field(files: DataFrame, updates: DataFrame, field: str) -> tuple[DataFrame, DataFrame]:
    """updates(file_md5, value), one for each file -> (files, audit rows "field: old → new"); empty tags show as 空; keys that aren't there change nothing."""
    new = updates.select("file_md5", F.col("value").alias("_new"), F.lit(True).alias("_hit"))
    joined = files.join(new, "file_md5", "left")
    show = lambda c: F.when(c.cast("string") == "", F.lit("空")).otherwise(c.cast("string"))
    detail = F.concat(F.lit(f"{field}: "), F.coalesce(show(F.col(field)), F.lit("空")), F.lit(" → "), F.coalesce(show(F.col("_new")), F.lit("空")))
    audit = audit_rows("update", detail, joined.where("_hit"))
    return joined.withColumn(field, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(field))).select(*files.columns), audit


def edited(old: Column, new: Column) -> Column:
    """Whether an edit is to be saved: it says something, and something else."""
    return F.coalesce((new != "") & (F.coalesce(old, F.lit("")) != new), F.lit(False))


def grouped(files: DataFrame) -> DataFrame:
    """One row for each file and each of its groups, `default` first, then by the file's list and name: group, pos, ..."""
    rows = files.select(F.explode(F.split("groups", "\\|", -1)).alias("group"), "*")
    order = Window.partitionBy("group").orderBy("groups", "file_name", "file_md5")
    return rows.withColumn("pos", F.row_number().over(order)).withColumn("is_default", F.col("group") == DEFAULT_GROUP)


def status_totals(files: DataFrame) -> DataFrame:
    """Documents and chunks as the status line has them: once in each group."""
    rows = files.select(F.explode(F.split("groups", "\\|", -1)).alias("group"), "total_chunks")
    return rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("total_chunks"), F.lit(0)).cast("long").alias("chunks"))


def overview(files: DataFrame, chunks: DataFrame, dim: int, stored: int = -1) -> DataFrame:
    """total_docs, enabled_docs, total_chunks, total_chars, latest_index, embedding_dim, storage_bytes; of one row."""
    f = files.agg(F.count("*").alias("total_docs"), F.count_if("is_enabled").alias("enabled_docs"), F.coalesce(F.sum("total_chunks"), F.lit(0)).cast("long").alias("total_chunks"), F.max(F.when(F.col("total_chunks") > 0, F.col("indexed_at"))).alias("latest_index"))
    c = chunks.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("total_chars"))
    return f.crossJoin(c).select("total_docs", "enabled_docs", "total_chunks", "total_chars", "latest_index", F.lit(dim).alias("embedding_dim"), F.lit(stored).cast("long").alias("storage_bytes"))
