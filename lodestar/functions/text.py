"""Text expressions: stripping, keyword tags, display formats, names, source locators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FINANCE_TERMS = ("营业收入", "净利润", "毛利率", "资产负债率", "ROE", "ROA", "现金流", "应收账款", "应付账款", "存货", "固定资产", "无形资产")


def strip(c: Column) -> Column:
    """Without white space of any script at either end; trim() takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def keywords(c: Column, terms: Sequence[str] = FINANCE_TERMS) -> Column:
    """The terms that the text holds, in the order of the list."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(c, t))


def document_name(path: Column) -> Column:
    """Last part of the path without a .pdf ending; other endings stay."""
    return F.regexp_replace(F.element_at(F.split(path, "[/\\\\]"), -1), r"(?i)\.pdf$", "")


def chars_display(n: Column) -> Column:
    """1,234 字符, or 1.2 万字符 from 10,000 on; — for null or negative."""
    tenths = F.bround(n.cast("decimal(38,6)") / 10_000, 1)
    return F.when(n.isNull() | (n < 0), F.lit("—")).when(n >= 10_000, F.concat(F.format_string("%.1f", tenths.cast("double")), F.lit(" 万字符"))).otherwise(F.concat(F.format_number(n, 0), F.lit(" 字符")))


def bytes_display(n: Column) -> Column:
    """B, KB and MB with one decimal, GB with two."""
    part = lambda by, digits, unit: F.concat(F.format_string(f"%.{digits}f", F.bround(n / F.lit(float(by)), digits)), F.lit(unit))
    return F.when(n >= 1 << 30, part(1 << 30, 2, " GB")).when(n >= 1 << 20, part(1 << 20, 1, " MB")).when(n >= 1 << 10, part(1 << 10, 1, " KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def file_size_display(n: Column) -> Column:
    """The catalog's short form: KB below a thousand and twenty-four, MB above."""
    kb = n / F.lit(1024.0)
    return F.when(kb < 1024, F.concat(F.format_string("%.1f", F.bround(kb, 1)), F.lit("KB"))).otherwise(F.concat(F.format_string("%.1f", F.bround(kb / 1024, 1)), F.lit("MB")))


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent, halves to even; null where there is nothing."""
    return F.when(whole > 0, F.bround(part.cast("double") / whole * 100, 0).cast("int"))


def page_list(pages: Column) -> Column:
    """[1, 2] as text."""
    return F.concat(F.lit("["), F.array_join(pages.cast("array<string>"), ", "), F.lit("]"))


def locator(pages: Column, chapter: Column, index: Column, glue: str = " — ", chapter_label: str = "") -> Column:
    """页码 [..] if there are pages, the chapter if there is one, and the chunk's number always."""
    has_pages = F.coalesce(F.size(pages) > 0, F.lit(False))
    has_chapter = F.coalesce(chapter != "", F.lit(False))
    return F.concat_ws(glue, F.when(has_pages, F.concat(F.lit("页码 "), page_list(pages))), F.when(has_chapter, F.concat(F.lit(chapter_label), chapter)), F.concat(F.lit("chunk #"), F.coalesce(index.cast("string"), F.lit("?"))))


def minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")
