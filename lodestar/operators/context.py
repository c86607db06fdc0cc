"""The context of an answer: numbered parts with locators, trimmed in the middle, and past turns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.config import Config, tokens_to_chars
from lodestar.functions.arrow import pieces
from lodestar.functions.text import locator

LOW_CONFIDENCE = "（以下回答基于低相关度资料，仅供参考）\n\n"


def part(number: Column, doc_name: Column, doc_id: Column, pages: Column, chapter: Column, index: Column, text: Column) -> Column:
    """--- 文档片段 1 (来源: name, 页码 [3], 章节 title, chunk #5) --- and the text."""
    name = F.coalesce(F.nullif(doc_name, F.lit("")), doc_id.cast("string"))
    where = locator(pages, chapter, index, ", ", "章节 ")
    return F.concat(F.lit("--- 文档片段 "), number.cast("string"), F.lit(" (来源: "), name, F.lit(", "), where, F.lit(") ---\n"), text)


def trimmed(parts: list[str], limit: int) -> list[str]:
    """Parts without those in the middle until all, with a blank line between, are within the limit or two are left; then … in the middle."""
    size = sum(map(len, parts)) + 2 * (len(parts) - 1)
    if size <= limit or len(parts) <= 2:
        return list(parts)
    parts = list(parts)
    while len(parts) > 2 and size > limit:
        size -= len(parts.pop(len(parts) // 2)) + 2
    parts.insert(len(parts) // 2, "…")
    return parts


def trim(parts: Column, config: Config = Config(), limit: int | None = None) -> Column:
    """array<string> -> the context as one text. What goes depends on what went before, so a fold over each query's few parts."""
    most = tokens_to_chars(config.context_tokens) if limit is None else limit

    def join(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for rows in pieces(batch):
                yield pa.array([None if p is None else "\n\n".join(trimmed(p, most)) for p in rows.to_pylist()], pa.string())

    return F.arrow_udf(join, "string")(parts)


def contexts(chunks: DataFrame, config: Config = Config(), limit: int | None = None) -> DataFrame:
    """chunks(query_id, doc_id, doc_name, page_nums, chapter_title, chunk_index, text) -> query_id, context; in the order of document and chunk."""
    row = F.struct("doc_id", "chunk_index", "doc_name", "page_nums", "chapter_title", "text")
    grouped = chunks.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("c"))
    each = F.transform("c", lambda c, i: part(i + 1, c["doc_name"], c["doc_id"], c["page_nums"], c["chapter_title"], c["chunk_index"], c["text"]))
    return grouped.select("query_id", trim(each, config, limit).alias("context"))


def history(turns: Column, keep: int = 5) -> Column:
    """array<struct<query, answer, sources>> -> the last `keep` turns (0: all), numbered from 1; "" without turns."""
    last = turns if not keep else F.slice(turns, F.greatest(F.size(turns) - keep + 1, F.lit(1)), keep)
    ref = lambda s: F.concat(F.coalesce(s["doc_name"], F.lit("?")), F.lit(" ("), locator(s["page_nums"], s["chapter_title"], s["chunk_index"], ", ", "章节 "), F.lit(")"))

    def block(t: Column, i: Column) -> Column:
        refs = F.when(F.size(t["sources"]) > 0, F.array_join(F.transform(t["sources"], ref), ", ")).otherwise(F.lit("无"))
        return F.concat(F.lit("历史问答 "), (i + 1).cast("string"), F.lit(":\n  问题: "), F.coalesce(t["query"], F.lit("")), F.lit("\n  回答: "), F.coalesce(t["answer"], F.lit("")), F.lit("\n  参考文档: "), refs)

    text = F.concat(F.lit("[历史对话]\n"), F.array_join(F.transform(last, block), "\n"), F.lit("\n---"))
    return F.when(F.coalesce(F.size(turns), F.lit(0)) <= 0, F.lit("")).otherwise(text)


def user_message(query: Column, context: Column, past: Column) -> Column:
    return F.concat(F.when(past != "", F.concat(past, F.lit("\n\n"))).otherwise(F.lit("")), F.lit("文档片段：\n\n"), context, F.lit("\n\n请回答以下问题："), query)


def source_ref(doc_name: Column, doc_id: Column, pages: Column, index: Column, chapter: Column, chapter_index: Column, score: Column) -> Column:
    """What a turn keeps of a chunk: no text."""
    return F.struct(F.coalesce(F.nullif(doc_name, F.lit("")), doc_id).alias("doc_name"), pages.alias("page_nums"), index.alias("chunk_index"), chapter.alias("chapter_title"), chapter_index.alias("chapter_index"), score.alias("llm_score"))
