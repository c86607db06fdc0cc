"""Chunking of plain text: chapters by title rules, paragraphs gathered greedily, oversize chunks cut at lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.config import Config
from lodestar.functions.arrow import pieces
from lodestar.functions.text import strip

_NUMERALS = "两〇零千百十九八七六五四三二一０-９\\d"
#: Title rules, tried in this order. The flags make \s, \d and . mean what they mean in Unicode text with \n as the only line end.
CHAPTER_RULES = (
    rf"(?mdU)^.{{0,20}}第[{_NUMERALS}]+[篇部卷节回章].{{0,30}}$",
    r"(?mdU)^\s{0,8}\d{1,4}[.．、\s]\s*\S.{0,28}$",
    r"(?mdU)^\s{0,8}[cC]hapter\s+\d+.{0,40}$",
)


def rule_counts(text: Column, config: Config = Config()) -> Column:
    """Titles that each rule finds in the first part of the text."""
    head = F.left(text, F.lit(config.chapter_scan_chars))
    return F.array(*[F.regexp_count(head, F.lit(rule)) for rule in CHAPTER_RULES])


def required_titles(text: Column, density: int, config: Config = Config()) -> Column:
    """One title for each `density` characters of the first part, one at least."""
    return F.greatest(F.lit(1), F.floor(F.least(F.length(text), F.lit(config.chapter_scan_chars)) / density)).cast("int")


def chapter_rule(text: Column, config: Config = Config()) -> Column:
    """Number of the first rule (from 1) that is dense enough; null if none is, or the text is empty."""
    counts, need = rule_counts(text, config), required_titles(text, config.chapter_density_rules, config)
    found = F.array_position(F.transform(counts, lambda n: n >= need), F.lit(True))
    return F.when((F.length(text) > 0) & (found > 0), found.cast("int"))


def chapters(text: Column, rule: Column) -> Column:
    """array<struct<title, text>>: from each title to the next. What stands before the first title is left out.

    Titles are marked by a control character that no text should hold, and the text is cut at the marks."""
    mark = "\x01"
    out = F.lit(None).cast("array<string>")
    titles = F.lit(None).cast("array<string>")
    clean = F.translate(text, mark, "")
    for i, pattern in enumerate(CHAPTER_RULES, 1):
        out = F.when(rule == i, F.split(F.regexp_replace(clean, f"({pattern})", mark + "$1"), mark, -1)).otherwise(out)
        titles = F.when(rule == i, F.regexp_extract_all(clean, F.lit(f"({pattern})"), 1)).otherwise(titles)
    bodies = F.slice(out, 2, F.greatest(F.size(out) - 1, F.lit(0)))
    return F.zip_with(titles, bodies, lambda t, b: F.struct(strip(t).alias("title"), strip(b).alias("text")))


def _gather(parts: list[str], limit: int, glue: str, own: int) -> list[str]:
    """Joins parts until the next one would take the sum of (length + own) over the limit; no part is cut."""
    out, held, size = [], [], 0
    for part in parts:
        if held and size + len(part) + own > limit:
            out.append(glue.join(held))
            held, size = [], 0
        held.append(part)
        size += len(part) + own
    if held:
        out.append(glue.join(held))
    return out


def paragraph_chunks(text: Column, limit: int, separator: str = "\n\n") -> Column:
    """array<string>: paragraphs gathered greedily up to `limit` characters, separators not counted; blank chunks are dropped.

    A fold over strings: an Arrow function was faster here than aggregate(), which copies its arrays at every step."""

    def gather(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in pieces(batch):
                yield pa.array([None if t is None else [c for c in (x.strip() for x in _gather(t.split(separator), limit, separator, 0)) if c] for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(gather, "array<string>")(text)


def _table_parts(text: str, limit: int, repeat_header: bool) -> list[str]:
    """Lines of an oversize table in pieces, each led by the marker lines before the first table line.

    Lines before the first table line that aren't markers go with the prefix only if repeat_header is set."""
    marks = ("[概述]", "[表头]")
    all_lines = text.split("\n")
    first = next((i for i, x in enumerate(all_lines) if x.strip().startswith("|")), None)
    if first is None:
        return [text]
    head = [x for x in all_lines[:first] if repeat_header or x.startswith(marks)]
    prefix = "\n".join(head) + "\n" if head else ""
    return [prefix + piece for piece in _gather(all_lines[first:], limit - len(prefix), "\n", 1)]


def _text_parts(text: str, limit: int, separator: str) -> list[str]:
    parts = text.split(separator)
    prefix = ""
    if parts[0].startswith("[概述]"):
        prefix = parts.pop(0) + separator
    return [prefix + piece for piece in _gather(parts, limit - len(prefix), separator, len(separator))] or [text]


def split_oversize(text: Column, kind: Column, limit: int = 5000, separator: str = "\n\n", repeat_header: bool = False) -> Column:
    """array<string>: the text alone if it is within the limit; else a table at its lines, all else at paragraphs.

    Separators count here. A part over the limit stays whole."""

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            for rows in pieces(pa.RecordBatch.from_arrays(list(columns), ["text", "kind"])):
                pairs = zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())
                yield pa.array([None if t is None else [t] if len(t) <= limit else _table_parts(t, limit, repeat_header) if k == "table" else _text_parts(t, limit, separator) for t, k in pairs], pa.list_(pa.string()))

    return F.arrow_udf(cut, "array<string>")(text, kind)


def numbered(df: DataFrame, parts: str, doc: str = "doc_id") -> DataFrame:
    """One row for each element of `parts`: chunk_id, chunk_index from 0, text, length; the array goes."""
    rest = [c for c in df.columns if c != parts]
    return df.select(*rest, F.posexplode(parts).alias("chunk_index", "text")).withColumn("chunk_id", F.concat(F.col(doc).cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string"))).withColumn("length", F.length("text"))


def by_paragraphs(docs: DataFrame, limit: int, separator: str = "\n\n") -> DataFrame:
    """documents(doc_id, text) -> doc_id, chunk_index, text, chunk_id, length."""
    return numbered(docs.select("doc_id", paragraph_chunks(F.col("text"), limit, separator).alias("parts")), "parts")


def chunk_texts(docs: DataFrame, config: Config = Config(), separator: str = "\n\n", regex_model: Callable | None = None) -> DataFrame:
    """documents(doc_id, text) -> chunks with chapter_title and chapter_index ("2/7"); null where no rule fits and paragraphs serve.

    regex_model: makes a model that is asked for a pattern of titles where no rule fits; its answers are had once, as the
    rows are used once.

    Chapters up to the soft limit are one chunk; longer ones are gathered by paragraph; numbers run on over the chapters."""
    ruled = docs.select("doc_id", "text", chapter_rule(F.col("text"), config).alias("rule"))
    ruled_chapters = chapters(F.col("text"), F.col("rule"))
    if regex_model is not None:
        ruled_chapters = F.when(F.col("rule").isNull(), model_chapters(F.col("text"), regex_model, config)).otherwise(ruled_chapters)
    found = ruled.withColumn("chapters", F.coalesce(ruled_chapters, F.array().cast("array<struct<title:string,text:string>>")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.col("text").alias("text")))
    total = F.size("chapters")
    rows = found.select("doc_id", total.alias("total"), F.posexplode(F.when(total > 0, F.col("chapters")).otherwise(whole)).alias("i", "chapter"))
    rows = rows.select("doc_id", "total", "i", F.col("chapter.title").alias("title"), F.col("chapter.text").alias("text"))
    short = (F.col("total") > 0) & (F.length("text") <= config.chunk_soft_max)
    parts = F.when(short, F.array("text")).otherwise(paragraph_chunks(F.col("text"), config.chunk_soft_max, separator))
    rows = rows.select("doc_id", "total", "i", "title", F.posexplode(parts).alias("j", "text"))
    index = F.row_number().over(_window("doc_id", "i", "j")) - 1
    label = F.when(F.col("total") > 0, F.concat((F.col("i") + 1).cast("string"), F.lit("/"), F.col("total").cast("string")))
    return rows.select("doc_id", index.alias("chunk_index"), F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), index.cast("string")).alias("chunk_id"), F.col("title").alias("chapter_title"), label.alias("chapter_index"), "text", F.length("text").alias("length"))


def _window(part: str, *order: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(part).orderBy(*order)


def parse_regex_answer(answer: str) -> str | None:
    """The pattern in a model's answer: what follows "regex:" on the last line that begins so, else all of it; NONE and blank give None."""
    bare = [line.strip().strip("`").lstrip() for line in answer.splitlines()]
    marked = [line[6:] for line in bare if line[:6].lower() == "regex:"]
    pattern = (marked or [answer])[-1].strip().strip("`").strip()
    return pattern if pattern and pattern.upper() != "NONE" else None


def model_chapter_regex(text: str, ask: Callable[[str], str], config: Config = Config()) -> str | None:
    """A title pattern from a model, asked at most twice; one that doesn't compile or is too sparse is told to it the second time."""
    failed: str | None = None
    scanned = text[: config.chapter_scan_chars]
    need = max(1, len(scanned) // config.chapter_density_model)
    for sample in (6000, 12000):
        shown = text if len(text) <= sample else text[:3000] + "\n...\n" + text[sample - 3000 : sample]
        prompt = shown if failed is None else f"{shown}\n\nfailed: {failed}"
        pattern = parse_regex_answer(ask(prompt))
        if pattern is None:
            continue
        try:
            if len(re.findall(pattern, scanned, re.MULTILINE)) >= need:
                return pattern
        except re.error:
            pass
        failed = pattern
    return None


def chapters_by(pattern: str, text: str) -> list[tuple[str, str]]:
    """(title, text) of the chapters that a pattern finds in one text; for patterns that a model gave."""
    at = [(m.start(), m.group(0).strip()) for m in re.finditer(pattern, text, re.MULTILINE)]
    return [(title, text[begin : at[i + 1][0] if i + 1 < len(at) else len(text)].strip()) for i, (begin, title) in enumerate(at)]


def model_chapters(text: Column, make: Callable, config: Config = Config()) -> Column:
    """array<struct<title,text>> by a pattern that a model gives; null where it gives none that serves."""

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            out = []
            for t in batch:
                pattern = model_chapter_regex(t, model.ask, config) if t else None
                out.append([{"title": a, "text": b} for a, b in chapters_by(pattern, t)] if pattern else None)
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(find, "array<struct<title:string,text:string>>").asNondeterministic()(text)
