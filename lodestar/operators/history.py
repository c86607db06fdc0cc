"""Sessions of questions and answers: turns are the facts, a session is their aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import locator

TITLE = 40


def sessions(turns: DataFrame) -> DataFrame:
    """session_id, title (the first query's first characters), turn_count, tokens, elapsed_ms, created_at, updated_at."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return turns.groupBy("session_id").agg(F.left(F.min_by("query", "turn_no"), F.lit(TITLE)).alias("title"), F.count("*").alias("turn_count"), total("input_tokens"), total("output_tokens"), total("elapsed_ms"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))


def session_list(rows: DataFrame, limit: int = 30) -> DataFrame:
    """The newest sessions, without their messages."""
    return rows.orderBy(F.col("updated_at").desc(), "session_id").limit(limit)


def next_turns(turns: DataFrame, new: DataFrame) -> DataFrame:
    """New turns numbered on after those their sessions have; a session that isn't there begins with 1."""
    have = turns.groupBy("session_id").agg(F.max("turn_no").alias("_have"))
    order = Window.partitionBy("session_id").orderBy("created_at", "query")
    return new.join(have, "session_id", "left").withColumn("turn_no", (F.coalesce("_have", F.lit(0)) + F.row_number().over(order)).cast("int")).drop("_have")


def restore(turns: DataFrame, session_id: str | None = None) -> DataFrame:
    """session_id, messages: turns in order as nested rows; of one session, or of all."""
    rows = turns if session_id is None else turns.where(F.col("session_id") == session_id)
    fields = [c for c in rows.columns if c not in ("session_id", "turn_no")]
    return rows.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("turn_no", *fields))).alias("messages"))


def parse_messages(text: Column, schema: str) -> Column:
    """Turns of stored JSON; malformed gives none."""
    return F.coalesce(F.from_json(text, f"array<{schema}>"), F.array().cast(f"array<{schema}>"))


def token_split(rows: DataFrame) -> DataFrame:
    """Tokens of searches and of indexing, by session: rows(session_id, kind, input_tokens, output_tokens)."""
    both = F.col("input_tokens") + F.col("output_tokens")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, both)), F.lit(0)).cast("long")
    return rows.groupBy("session_id").agg(of("search").alias("search_tokens"), of("index").alias("index_tokens"))


def export_markdown(turns: DataFrame) -> DataFrame:
    """session_id, markdown: the talk as a Markdown text with sources and tokens."""
    source = lambda s: F.concat(F.lit("- "), F.coalesce(s["doc_name"], F.lit("?")), F.lit(" — "), locator(s["page_nums"], s["chapter_title"], s["chunk_index"]), F.coalesce(F.concat(F.lit(" — LLM得分="), s["llm_score"].cast("string")), F.lit("")), F.lit("\n"))

    def turn(t: Column, i: Column) -> Column:
        refs = F.when(F.size(t["sources"]) > 0, F.concat(F.lit("**来源引用：**\n"), F.array_join(F.transform(t["sources"], source), ""), F.lit("\n"))).otherwise(F.lit(""))
        return F.concat(
            F.lit("## 第 "), (i + 1).cast("string"), F.lit(" 轮\n\n**问：** "), F.coalesce(t["query"], F.lit("")), F.lit("\n\n**答：** "), F.coalesce(t["answer"], F.lit("")), F.lit("\n\n"),
            refs, F.lit("**Tokens：** "), F.coalesce(t["input_tokens"], F.lit(0)).cast("string"), F.lit("/"), F.coalesce(t["output_tokens"], F.lit(0)).cast("string"), F.lit("\n"),
        )

    rows = restore(turns)
    head = F.concat(F.lit("# 对话导出\n\n- 会话 ID: "), F.coalesce("session_id", F.lit("（未保存）")), F.lit("\n- 轮数: "), F.size("messages").cast("string"), F.lit("\n\n"))
    return rows.select("session_id", F.concat(head, F.array_join(F.transform("messages", turn), "\n")).alias("markdown"))
