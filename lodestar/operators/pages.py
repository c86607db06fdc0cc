"""Pages of a document: kinds, the numbered form a model reads, batches, and the map of chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import lines, strip

BLANK, TABLE, TEXT = "空白页", "含表格", "纯文本"


def page_type(text: Column) -> Column:
    """Blank, with a table (two lines or more that begin with a bar), or text."""
    bars = F.size(F.filter(lines(text), lambda x: F.startswith(strip(x), F.lit("|"))))
    return F.when(strip(text) == "", F.lit(BLANK)).when(bars >= 2, F.lit(TABLE)).otherwise(F.lit(TEXT))


def numbered_lines(text: Column) -> Column:
    return F.array_join(F.transform(lines(text), lambda x, i: F.concat(F.lit("L"), (i + 1).cast("string"), F.lit(": "), x)), "\n")


def page_for_model(page: Column, total: Column, text: Column) -> Column:
    """[第1页，共3页]  [纯文本] and numbered lines; of a blank page a note."""
    kind = page_type(text)
    head = F.concat(F.lit("[第"), page.cast("string"), F.lit("页，共"), total.cast("string"), F.lit("页]  ["), kind, F.lit("]"))
    return F.concat(head, F.lit("\n"), F.when(kind == BLANK, F.lit("（本页为空）")).otherwise(numbered_lines(text)))


def batches(pages: DataFrame, size: int = 3) -> DataFrame:
    """pages(doc_id, page, text) -> doc_id, batch, first_page, last_page, text; documents without any text have none."""
    alive = Window.partitionBy("doc_id")
    marked = pages.withColumn("_some", F.max(strip(F.col("text")) != "").over(alive)).withColumn("_total", F.max("page").over(alive)).where("_some")
    piece = F.struct("page", page_for_model(F.col("page"), F.col("_total"), F.col("text")).alias("text"))
    grouped = marked.groupBy("doc_id", F.floor((F.col("page") - 1) / size).cast("int").alias("batch")).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.sort_array(F.collect_list(piece)).alias("p"))
    return grouped.select("doc_id", "batch", "first_page", "last_page", F.array_join(F.col("p.text"), "\n\n").alias("text"))


def fetched_page(page: int, pages: list[str]) -> str:
    """What a model gets that asks for a page (from 1)."""
    if not 1 <= page <= len(pages):
        return f"页码 {page} 超出范围（1-{len(pages)}）"
    text = pages[page - 1]
    if not text.strip():
        return f"第{page}页为空白页"
    return f"[第{page}页]\n" + "\n".join(f"L{i}: {line}" for i, line in enumerate(text.split("\n"), 1))


HEADING = r"#{1,3}\s+(.+)"


def chapter_map(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, text) -> doc_id, start, end, title: each heading among the first 200 characters of a page opens a chapter,
    which ends before the next one, the last one at the last page with text."""
    some = pages.where(strip(F.col("text")) != "")
    last = F.max("page").over(Window.partitionBy("doc_id"))
    title = strip(F.regexp_extract(F.left("text", F.lit(200)), HEADING, 1))
    heads = some.select("doc_id", "page", last.alias("last"), F.when(F.left("text", F.lit(200)).rlike(HEADING), title).alias("title")).where("title is not null")
    after = F.lead(F.col("page") - 1).over(Window.partitionBy("doc_id").orderBy("page"))
    return heads.select("doc_id", F.col("page").alias("start"), F.coalesce(after, F.col("last")).alias("end"), F.when(F.col("title") == "", F.lit("未命名")).otherwise(F.col("title")).alias("title"))


def chapters_of_batches(batch_ranges: DataFrame, chapter_rows: DataFrame) -> DataFrame:
    """The chapters that overlap each batch (doc_id, batch, first_page, last_page): an equi join on the document, then the overlap."""
    joined = batch_ranges.join(chapter_rows, "doc_id")
    return joined.where((F.col("start") <= F.col("last_page")) & (F.col("end") >= F.col("first_page"))).select("doc_id", "batch", "start", "end", "title")


def map_text(overlaps: DataFrame) -> DataFrame:
    """The map of each batch as the table that a model reads before the pages."""
    row = F.struct("start", F.concat(F.lit("| "), F.col("start").cast("string"), F.lit(" | "), F.col("end").cast("string"), F.lit(" | "), F.col("title"), F.lit(" |")).alias("row"))
    head = "## 章节地图（供参考，了解当前内容所属章节）\n| 起始页 | 结束页 | 章节标题 |\n|--------|--------|----------|\n"
    grouped = overlaps.groupBy("doc_id", "batch").agg(F.sort_array(F.collect_list(row)).alias("r"))
    return grouped.select("doc_id", "batch", F.concat(F.lit(head), F.array_join(F.col("r.row"), "\n")).alias("text"))
