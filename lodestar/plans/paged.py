"""Documents of pages (PDF): a reader gives the pages, a model that sees them in batches says where chunks begin and end, lines
that it missed are found and put right, and what comes out are chunks.

Readers and models are seams (lodestar.sources.providers). They aren't deterministic, so each of their answers is written
once, to a table of the given folder, before anything is made of it; a lost executor doesn't ask again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.config import Config
from lodestar.functions.text import lines, strip
from lodestar.operators import assembly, chunking, correction, pages, tables
from lodestar.schemas import CHUNK_DEFINITION, PAGE_RESULT, SEGMENT, WORD
from lodestar.sources import providers
from lodestar.sources.store import Scratch

READ = f"doc_id string, page int, text string, words array<{WORD}>, avg_confidence double, error string"
DEFINED = f"doc_id string, batch int, ord int, {CHUNK_DEFINITION[len('struct<') : -1].replace(':', ' ', 1)}"


def read_pages(files: DataFrame, make: Callable[[], providers.Ocr]) -> DataFrame:
    """files(doc_id, content) -> READ: a row for each page; a page that fails has an error, as has page 0 of a file that can't be opened."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            for doc, content in zip(pdf["doc_id"], pdf["content"]):
                try:
                    rows = model.pages(bytes(content))
                except Exception as error:  # one file that can't be read doesn't stop the rest
                    rows = [{"page": 0, "error": f"{type(error).__name__}: {error}"}]
                yield pd.DataFrame([(doc, r["page"], r.get("text"), r.get("words"), r.get("avg_confidence"), r.get("error")) for r in rows], columns=["doc_id", "page", "text", "words", "avg_confidence", "error"])

    return files.select("doc_id", "content").mapInPandas(read, READ)


def page_results(read: DataFrame, config: Config = Config()) -> DataFrame:
    """Pages as read -> PAGE_RESULT: words with their places become a table and its text; all texts are corrected.

    The mean confidence is that of the words from the least one on, or what the reader says; a page that failed has an empty text."""
    words = read.where("words is not null").select("doc_id", "page", F.posexplode("words").alias("word_no", "w")).select("doc_id", "page", "word_no", "w.*")
    built = tables.tables(words, config.min_confidence, overlap=config.row_overlap, min_gap=config.min_column_gap, covered_share=config.gap_row_ratio)
    sure = F.transform(F.filter("words", lambda w: w["confidence"] >= config.min_confidence), lambda w: w["confidence"].cast("double"))
    rows = read.where("page > 0").join(built, ["doc_id", "page"], "left")
    rows = rows.withColumn("text", F.when(F.col("error").isNotNull(), F.lit("")).otherwise(F.coalesce("text", tables.markdown(F.col("cells")), F.lit(""))))
    rows = rows.withColumn("avg_confidence", F.coalesce("avg_confidence", tables.mean_confidence(sure), F.lit(0.0)))
    fixed = correction.corrected(rows)
    grid = F.when(F.col("cells").isNull(), F.array().cast("array<array<array<string>>>")).otherwise(F.array("cells"))
    return fixed.select("doc_id", "page", F.col("corrected.text").alias("text"), grid.alias("tables"), "avg_confidence", F.col("corrected.corrections").cast("int").alias("corrections"), F.col("corrected.entity_corrections").cast("int").alias("entity_corrections"), "error").to(_schema(fixed, PAGE_RESULT))


def _schema(df: DataFrame, text: str):
    return df.sparkSession.createDataFrame([], text).schema


def correction_totals(results: DataFrame) -> DataFrame:
    """doc_id, pages, corrections, entity_corrections, mean_confidence of each document's pages."""
    return results.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("corrections").alias("corrections"), F.sum("entity_corrections").alias("entity_corrections"), F.round(F.avg("avg_confidence"), 6).alias("mean_confidence"))


def messages(page_rows: DataFrame, config: Config = Config()) -> DataFrame:
    """pages(doc_id, page, text) -> doc_id, batch, first_page, last_page, text: what the model reads; led by the map of chapters if the settings ask for one."""
    made = pages.batches(page_rows, config.pages_per_batch)
    if config.chapter_map_mode != "rule_only":
        return made
    overlaps = pages.chapters_of_batches(made.select("doc_id", "batch", "first_page", "last_page"), pages.chapter_map(page_rows))
    led = made.join(pages.map_text(overlaps).withColumnRenamed("text", "map"), ["doc_id", "batch"], "left")
    return led.withColumn("text", F.concat_ws("\n\n", "map", "text")).drop("map")


def tool_loop(model: providers.PageModel, message: str, page_texts: list[str], config: Config = Config()) -> list[dict]:
    """The chunk definitions that a model submits for a batch. It may ask for other pages up to fetch_page_limit times, then it has to submit.

    The first submission ends it; a plain answer is parsed; no submission at all is an error."""
    talk = [{"role": "user", "content": message}]
    for asked in range(config.fetch_page_limit + 1):
        forced = asked == config.fetch_page_limit
        reply = model.reply(talk, forced)
        if reply.get("tool") == "submit_chunks":
            return reply.get("chunks") or []
        if reply.get("tool") != "fetch_page":
            return assembly.parse_definitions(reply.get("text") or "")
        if forced:
            break
        talk += [{"role": "assistant", "content": f"fetch_page({reply.get('page')})"}, {"role": "tool", "content": pages.fetched_page(int(reply.get("page") or 0), page_texts)}]
    raise RuntimeError(f"no chunks after {config.fetch_page_limit} pages")


def _definition(doc: str, batch: int, ord_: int, found: dict) -> tuple:
    """A model's definition as a row; what isn't of the right kind is as if it weren't there."""

    def number(x) -> int | None:
        return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None

    header = found.get("header_source")
    header = {"page": number(header.get("page")), "lines": [n for n in map(number, header.get("lines") or []) if n is not None]} if isinstance(header, dict) else None
    parts = [s for s in found.get("segments") or [] if isinstance(s, dict)]
    parts = [{"page": number(s.get("page")), "line_range": [number(n) for n in s.get("line_range") or []]} for s in parts]
    return doc, batch, ord_, found.get("chunk_type"), found.get("context_summary"), header, [p for p in parts if None not in p["line_range"]]


def define(asked: DataFrame, page_rows: DataFrame, make: Callable[[], providers.PageModel], config: Config = Config()) -> DataFrame:
    """messages (doc_id, batch, text) and pages -> DEFINED: a document's batches meet its pages in one task, as the model may ask for any of them."""

    def one(key: tuple, mine: pd.DataFrame, all_: pd.DataFrame) -> pd.DataFrame:
        model, out = make(), []
        texts = dict(zip(all_["page"], all_["text"].fillna("")))
        shown = [texts.get(i, "") for i in range(1, max(texts, default=0) + 1)]
        for batch, text in sorted(zip(mine["batch"], mine["text"])):
            out += [_definition(key[0], batch, i, d) for i, d in enumerate(tool_loop(model, text, shown, config))]
        return pd.DataFrame(out, columns=["doc_id", "batch", "ord", "chunk_type", "context_summary", "header_source", "segments"])

    return asked.groupBy("doc_id").cogroup(page_rows.select("doc_id", "page", "text").groupBy("doc_id")).applyInPandas(one, DEFINED)


def own_definitions(definitions: DataFrame, asked: DataFrame) -> DataFrame:
    """Those whose segments all lie on pages of their batch; one that reaches out of it is dropped."""
    span = asked.select("doc_id", "batch", F.sequence("first_page", "last_page").alias("batch_pages"))
    joined = definitions.join(span, ["doc_id", "batch"])
    return joined.where(assembly.in_batch(F.col("segments.page"), F.col("batch_pages"))).select(*definitions.columns)


def _segments(definitions: DataFrame) -> DataFrame:
    rows = definitions.select("doc_id", "batch", "ord", F.explode("segments").alias("s")).where(F.size("s.line_range") == 2)
    return rows.select("doc_id", "batch", "ord", F.col("s.page").alias("page"), F.col("s.line_range")[0].alias("first"), F.col("s.line_range")[1].alias("last"))


def missed(page_rows: DataFrame, definitions: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, page, missing, batch: lines with text that no definition covers; a segment counts as far as its page goes."""
    spans = _segments(definitions).join(page_rows.select("doc_id", "page", F.size(lines(F.col("text"))).alias("n")), ["doc_id", "page"])
    spans = spans.select("doc_id", "page", F.greatest("first", F.lit(1)).alias("first"), F.least("last", "n").alias("last"))
    return assembly.missing_lines(page_rows, spans).withColumn("batch", F.floor((F.col("page") - 1) / config.pages_per_batch).cast("int"))


def splice(definitions: DataFrame, again: DataFrame) -> DataFrame:
    """The definitions, those of batches that were asked anew replaced."""
    return definitions.join(again.select("doc_id", "batch").distinct(), ["doc_id", "batch"], "left_anti").unionByName(again)


def apply_fixes(definitions: DataFrame, decided: DataFrame) -> DataFrame:
    """decided(doc_id, page, line, chunk, batch): lines that a chunk gets grow its segments or become one more of them; lines
    without a chunk become chunks of their own, a run of neighbouring lines one."""
    line = F.struct("page", "line")
    grown = decided.where("chunk is not null").groupBy("doc_id", F.col("chunk").alias("key")).agg(F.sort_array(F.collect_list(line)).alias("more"))
    keyed = definitions.withColumn("key", _key()).join(grown, ["doc_id", "key"], "left")
    folded = F.aggregate("more", F.col("segments"), lambda held, x: assembly.extend_segments(held, x["page"], x["line"]).cast(f"array<{SEGMENT}>"))
    out = keyed.withColumn("segments", F.when(F.col("more").isNull(), F.col("segments")).otherwise(folded)).drop("key", "more")
    alone = decided.where("chunk is null").withColumn("run", F.col("line") - F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line")))
    runs = alone.groupBy("doc_id", "batch", "page", "run").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    after = definitions.groupBy("doc_id", "batch").agg(F.max("ord").alias("top"))
    number = F.row_number().over(Window.partitionBy("doc_id", "batch").orderBy("page", "first"))
    new = runs.join(after, ["doc_id", "batch"], "left").withColumn("ord", F.coalesce(F.col("top"), F.lit(-1)) + number)
    segment = F.array(F.struct("page", F.array("first", "last").alias("line_range"))).cast(f"array<{SEGMENT}>")
    rows = new.select("doc_id", "batch", F.col("ord").cast("int").alias("ord"), F.lit("text").alias("chunk_type"), F.lit("").alias("context_summary"), F.lit(None).cast("struct<page:int,lines:array<int>>").alias("header_source"), segment.alias("segments"))
    return out.unionByName(rows)


def _key():
    """A chunk's number in its document: batches after each other, in each the model's order."""
    return F.col("batch").cast("long") * 1_000_000 + F.col("ord")


def fix_lines(page_rows: DataFrame, definitions: DataFrame, missing: DataFrame, make: Callable[[], providers.FixModel]) -> DataFrame:
    """decided(doc_id, page, line, chunk, batch) for each missing line: a model sees it with the end of the chunk before it and the
    beginning of the one after it; without an answer it stands alone."""
    spans = _segments(definitions).select("doc_id", "page", "first", "last", _key().alias("chunk"))
    rows = assembly.orphans(missing, spans)
    chunks = assembly.assemble(definitions.withColumn("ord", _key()), page_rows).select("doc_id", F.col("ord").alias("chunk"), "text")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page", "line"]).reset_index(drop=True)
        shown = [{"id": i, "text": r.text, "before": r.context_before, "after": r.context_after} for i, r in enumerate(pdf.itertuples())]
        action = {a["id"]: a["action"] for a in make().fix(shown) if isinstance(a, dict) and a.get("id") in range(len(shown)) and "action" in a}
        return pd.DataFrame({"doc_id": pdf["doc_id"], "page": pdf["page"], "line": pdf["line"], "action": [action.get(i, "standalone") for i in range(len(pdf))]})

    fixes = assembly.orphan_context(rows, chunks, page_rows).groupBy("doc_id").applyInPandas(one, "doc_id string, page int, line int, action string")
    return assembly.decide(fixes, rows).join(missing.select("doc_id", "page", "batch"), ["doc_id", "page"])


def chunk_pages(spark: SparkSession, page_rows: DataFrame, folder: str, make: Callable[[], providers.PageModel], fix: Callable[[], providers.FixModel], config: Config = Config()) -> DataFrame:
    """pages(doc_id, page, text) -> doc_id, chunk_index, text, type, page_nums, length, keywords.

    Batches of which the model missed more than direct_fix_lines lines are asked anew, coverage_retries times, and told which
    lines those are; what is then missing goes line by line to the chunk before or after it, or stands alone. Long chunks are split."""
    work = Scratch(spark, folder)
    page_rows = work.keep("pages", page_rows.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text")))
    asked = work.keep("asked", messages(page_rows, config))
    found = work.keep("defined-0", own_definitions(define(asked, page_rows, make, config), asked))
    for i in range(config.coverage_retries):
        missing = missed(page_rows, found, config)
        total = missing.groupBy("doc_id", "batch").agg(F.sum(F.size("missing")).alias("n")).where(F.col("n") > config.direct_fix_lines)
        said = assembly.range_text(assembly.missing_ranges(missing)).withColumn("batch", F.floor((F.col("page") - 1) / config.pages_per_batch).cast("int"))
        said = said.groupBy("doc_id", "batch").agg(F.array_join(F.sort_array(F.collect_list(F.struct("page", "text")))["text"], "\n").alias("missed"))
        again = work.keep(f"again-{i}", asked.join(total.select("doc_id", "batch"), ["doc_id", "batch"]).join(said, ["doc_id", "batch"]))
        if not again.limit(1).count():
            break
        told = again.withColumn("text", F.concat(F.col("text"), F.lit("\n\n上次遗漏的行：\n"), F.col("missed"))).drop("missed")
        new = work.keep(f"anew-{i}", own_definitions(define(told, page_rows, make, config), asked))
        # a batch that gave nothing at all this time keeps what it had
        found = work.keep(f"defined-{i + 1}", splice(found, new))
    missing = work.keep("missing", missed(page_rows, found, config))
    if missing.limit(1).count():
        found = work.keep("fixed", apply_fixes(found, work.keep("decided", fix_lines(page_rows, found, missing, fix))))
    made = assembly.assemble(found.withColumn("ord", _key()), page_rows)
    parts = made.select("doc_id", "ord", "type", "page_nums", "keywords", F.posexplode(chunking.split_oversize(F.col("text"), F.col("type"), config.chunk_hard_max)).alias("part", "text"))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "part")) - 1
    return parts.where(strip(F.col("text")) != "").select("doc_id", index.alias("chunk_index"), "text", "type", "page_nums", F.length("text").alias("length"), "keywords")
