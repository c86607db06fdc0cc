"""From a model's chunk definitions and the pages to chunks; which lines they miss; and how missed lines are put right."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import FINANCE_TERMS, keywords, lines, strip
from lodestar.schemas import CHUNK_DEFINITION

#: What is shown of a neighbouring chunk.
CONTEXT = 300


def parse_definitions(answer: str) -> list[dict]:
    """Chunk definitions in a model's answer: an object with chunks, a list of such objects or of definitions, or the first
    balanced fragment that is one of these; a code fence around it is taken off. Anything else is a ValueError."""
    text = re.sub(r"^```\w*\s*|\s*```$", "", answer.strip())

    def chunks(value) -> list[dict] | None:
        if isinstance(value, dict) and isinstance(value.get("chunks"), list):
            return value["chunks"]
        if isinstance(value, list) and value and all(isinstance(x, dict) for x in value):
            nested = [x["chunks"] for x in value if isinstance(x.get("chunks"), list)]
            return [c for part in nested for c in part] if nested else value if all("segments" in x for x in value) else None
        return None

    decoder = json.JSONDecoder()
    for at in [0, *(m.start() for m in re.finditer(r"[\[{]", text))]:
        try:
            found = chunks(decoder.raw_decode(text, at)[0])
        except ValueError:
            continue
        if found is not None:
            return found
    raise ValueError("no chunk definitions in the answer")


def definitions_column(answer: Column) -> Column:
    """The same for well-formed answers, as an expression: an object with chunks, or a bare list; else null."""
    bare = F.regexp_replace(strip(answer), r"^```\w*\s*|\s*```$", "")
    return F.coalesce(F.from_json(bare, f"struct<chunks:array<{CHUNK_DEFINITION}>>")["chunks"], F.when(F.startswith(bare, F.lit("[")), F.from_json(bare, f"array<{CHUNK_DEFINITION}>")))


def in_batch(segment_pages: Column, batch_pages: Column) -> Column:
    """Whether all pages of the segments belong to the batch."""
    return F.size(F.array_except(segment_pages, batch_pages)) == 0


def cut_lines(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last (from 1, both in) of a page, drawn in to its bounds; null if nothing is left."""
    every = lines(text)
    lo, hi = F.greatest(F.lit(1), first), F.least(F.size(every), last)
    return F.when(lo <= hi, F.array_join(F.slice(every, lo, F.greatest(hi - lo + 1, F.lit(0))), "\n"))


def assemble(definitions: DataFrame, pages: DataFrame, terms=FINANCE_TERMS) -> DataFrame:
    """definitions(doc_id, ord, chunk_type, context_summary, header_source, segments) and pages(doc_id, page, text) ->
    doc_id, ord, type, text, page_nums, length, keywords.

    Each segment meets its page by an equi join and takes its lines from it. Segments that are no pair of lines or
    lie outside the page add nothing, a chunk without text is dropped, and keywords are those of the page text alone."""
    segment = definitions.select("doc_id", "ord", F.posexplode("segments").alias("seg", "s"))
    segment = segment.select("doc_id", "ord", "seg", F.col("s.page").alias("page"), F.get(F.col("s.line_range"), F.lit(0)).alias("first"), F.get(F.col("s.line_range"), F.lit(1)).alias("last"), F.size("s.line_range").alias("n"))
    got = segment.where("n = 2").join(pages, ["doc_id", "page"]).withColumn("part", cut_lines(F.col("text"), F.col("first"), F.col("last"))).where("part is not null")
    body = got.groupBy("doc_id", "ord").agg(F.sort_array(F.collect_list(F.struct("seg", "page", "part"))).alias("p"))
    body = body.select("doc_id", "ord", F.array_join(F.col("p.part"), "\n").alias("data"), F.array_distinct(F.col("p.page")).alias("page_nums")).where(strip(F.col("data")) != "")
    header = definitions.where("header_source is not null").select("doc_id", "ord", F.col("header_source.page").alias("page"), F.col("header_source.lines").alias("wanted"))
    every = lines(F.col("text"))
    inside = F.filter("wanted", lambda x: (x >= 1) & (x <= F.size(every)))
    header = header.join(pages, ["doc_id", "page"]).select("doc_id", "ord", F.array_join(F.transform(inside, lambda x: F.get(every, x - 1)), "\n").alias("header"))
    rows = definitions.select("doc_id", "ord", F.coalesce("chunk_type", F.lit("mixed")).alias("type"), F.col("context_summary").alias("summary")).join(body, ["doc_id", "ord"]).join(header, ["doc_id", "ord"], "left")
    text = F.concat_ws("\n", F.when(F.col("summary") != "", F.concat(F.lit("[概述] "), F.col("summary"))), F.when(F.col("header") != "", F.concat(F.lit("[表头]\n"), F.col("header"))), F.col("data"))
    return rows.select("doc_id", "ord", "type", text.alias("text"), "page_nums", F.length(text).alias("length"), keywords(F.col("data"), terms).alias("keywords"))


def missing_lines(pages: DataFrame, segments: DataFrame) -> DataFrame:
    """pages(doc_id, page, text), segments(doc_id, page, first, last) -> doc_id, page, missing: numbers of lines with text that no segment covers.

    Ranges become line numbers by sequence(), so coverage is a difference of two sets in each page."""
    covered = segments.where("first <= last").groupBy("doc_id", "page").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last")))).alias("covered"))
    numbered = F.transform(lines(F.col("text")), lambda x, i: F.struct((i + 1).alias("n"), (strip(x) != "").alias("some")))
    full = F.transform(F.filter(numbered, lambda x: x["some"]), lambda x: x["n"])
    joined = pages.select("doc_id", "page", full.alias("full")).join(covered, ["doc_id", "page"], "left")
    missing = F.array_sort(F.array_except("full", F.coalesce("covered", F.array().cast("array<int>"))))
    return joined.select("doc_id", "page", missing.alias("missing")).where(F.size("missing") > 0)


def missing_ranges(missing: DataFrame) -> DataFrame:
    """doc_id, page, missing -> doc_id, page, first, last: runs of missing lines, by islands of (line - row number)."""
    line = missing.select("doc_id", "page", F.explode("missing").alias("line"))
    island = F.col("line") - F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line"))
    return line.withColumn("island", island).groupBy("doc_id", "page", "island").agg(F.min("line").alias("first"), F.max("line").alias("last")).drop("island")


def range_text(ranges: DataFrame) -> DataFrame:
    """- 第2页: L3-L5, L9"""
    name = F.when(F.col("first") == F.col("last"), F.concat(F.lit("L"), F.col("first").cast("string"))).otherwise(F.concat(F.lit("L"), F.col("first").cast("string"), F.lit("-L"), F.col("last").cast("string")))
    grouped = ranges.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("first", name.alias("name")))).alias("r"))
    return grouped.select("doc_id", "page", F.concat(F.lit("- 第"), F.col("page").cast("string"), F.lit("页: "), F.array_join(F.col("r.name"), ", ")).alias("text"))


def orphans(missing: DataFrame, segments: DataFrame) -> DataFrame:
    """Each missing line with the nearest segment before and after it on its page: an as-of join in both directions.

    segments(doc_id, page, first, last, chunk). Segments and lines are stacked in line order, and the last segment end
    before, or the first segment begin after, is carried to the line by a window: no join on a range. -> doc_id, page, line, before, after."""
    line = missing.select("doc_id", "page", F.explode("missing").alias("line"))
    none = F.lit(None).cast("struct<at:int,chunk:long>")
    at = lambda c: F.struct(F.col(c).cast("int").alias("at"), F.col("chunk").cast("long").alias("chunk"))
    # the earlier of two chunks with one end wins, so it is the larger key
    ends = segments.select("doc_id", "page", F.col("last").alias("line"), F.lit(0).alias("kind"), at("last").alias("end"), none.alias("begin"))
    begins = segments.select("doc_id", "page", F.col("first").alias("line"), F.lit(2).alias("kind"), none.alias("end"), at("first").alias("begin"))
    asked = line.select("doc_id", "page", "line", F.lit(1).alias("kind"), none.alias("end"), none.alias("begin"))
    stacked = ends.unionByName(begins).unionByName(asked)
    down = Window.partitionBy("doc_id", "page").orderBy("line", F.col("kind"), F.col("end.chunk").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("doc_id", "page").orderBy(F.col("line").desc(), F.col("kind").desc(), F.col("begin.chunk").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    found = stacked.withColumn("before", F.last("end", True).over(down)).withColumn("after", F.last("begin", True).over(up))
    return found.where("kind = 1").select("doc_id", "page", "line", F.col("before.chunk").alias("before"), F.col("after.chunk").alias("after"))


def orphan_context(orphan_rows: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """The missing line's text, the end of the chunk before it and the beginning of the one after it; （无） as (无)."""
    text = chunks.select("doc_id", F.col("chunk").alias("_c"), F.col("text").alias("_t"))
    out = orphan_rows.join(pages.select("doc_id", "page", lines(F.col("text")).alias("_l")), ["doc_id", "page"], "left")
    out = out.withColumn("text", F.coalesce(F.get("_l", F.col("line") - 1), F.lit(""))).drop("_l")
    for side, take in (("before", F.right), ("after", F.left)):
        near = text.select("doc_id", F.col("_c").alias(side), take("_t", F.lit(CONTEXT)).alias(f"context_{side}"))
        out = out.join(near, ["doc_id", side], "left").fillna("(无)", [f"context_{side}"])
    return out.select("doc_id", "page", "line", "text", "before", "after", "context_before", "context_after")


def extend_segments(segments: Column, page: Column, line: Column) -> Column:
    """Segments with one more line: the first one on the page that ends just before it or begins just after it grows; else a new one is put in order."""
    fits = lambda s: (s["page"] == page) & ((F.get(s["line_range"], F.lit(1)) == line - 1) | (F.get(s["line_range"], F.lit(0)) == line + 1))
    at = F.array_position(F.transform(segments, lambda s: F.coalesce(fits(s), F.lit(False))), F.lit(True))
    first, last = (lambda s: F.get(s["line_range"], F.lit(0))), (lambda s: F.get(s["line_range"], F.lit(1)))
    grown = lambda s: F.struct(s["page"].alias("page"), F.when(last(s) == line - 1, F.array(first(s), line)).otherwise(F.array(line, last(s))).alias("line_range"))
    more = F.array_append(segments, F.struct(page.alias("page"), F.array(line, line).alias("line_range")))
    key = lambda s: F.struct(F.coalesce(s["page"], F.lit(0)).alias("p"), F.coalesce(first(s), F.lit(0)).alias("l"))
    ordered = F.array_sort(more, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))
    return F.when(at > 0, F.transform(segments, lambda s, i: F.when(i == at - 1, grown(s)).otherwise(s))).otherwise(ordered)


def decide(fixes: DataFrame, orphan_rows: DataFrame) -> DataFrame:
    """A model's decisions (doc_id, page, line, action) on missing lines -> doc_id, page, line, chunk: the chunk that gets
    the line; null where it stands alone, as it does without an answer or without a neighbour on that side."""
    joined = orphan_rows.join(fixes.select("doc_id", "page", "line", "action"), ["doc_id", "page", "line"], "left")
    return joined.select("doc_id", "page", "line", F.when(F.col("action") == "merge_before", F.col("before")).when(F.col("action") == "merge_after", F.col("after")).alias("chunk"))
