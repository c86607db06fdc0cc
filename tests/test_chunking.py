import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import chunking, pages


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


def greedy(text, limit, sep):
    out, held, size = [], [], 0
    for p in text.split(sep):
        if size + len(p) > limit and held:
            out.append(sep.join(held).strip())
            held, size = [], 0
        held.append(p)
        size += len(p)
    return [c for c in [*out, sep.join(held).strip()] if c]


def test_paragraphs_against_model(spark):
    rng = random.Random(3)
    rows = ["\n\n".join("x" * rng.randint(0, 300) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    got = chunking.by_paragraphs(texts(spark, *rows), 500).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.text) for r in got] == [(i, c) for i, t in enumerate(rows) for c in greedy(t, 500, "\n\n")]
    assert all(r.chunk_id == f"{r.doc_id}_chunk_{r.chunk_index}" for r in got)


def test_paragraph_is_never_cut(spark):
    got = chunking.by_paragraphs(texts(spark, "a" * 900 + "\n\nb", None, ""), 500).collect()
    assert [r.text for r in got] == ["a" * 900, "b"]


MAIN = "前言不要\n变脸之初卷 第一章 开始\n　　正文一\n变脸之初卷 第二章 中间\n　　正文二\n变脸之初卷 第三章 结束\n　　正文三"


def test_chapters_main_format(spark):
    got = chunking.chunk_texts(texts(spark, MAIN)).orderBy("chunk_index").collect()
    assert [r.chapter_index for r in got] == ["1/3", "2/3", "3/3"]
    assert got[0].chapter_title == "变脸之初卷 第一章 开始"
    assert got[0].text.endswith("正文一") and "前言" not in got[0].text


def test_chapter_rules(spark):
    rows = {"Chapter 1\nx\nchapter 2 y\nz": 3, "1. one\nbody\n2. two\nbody": 2, "nothing here": None, "": None, "第一章 x\n" + "y" * 20000: None}
    got = texts(spark, *rows).select("doc_id", chunking.chapter_rule(F.col("text")).alias("r")).orderBy("doc_id").collect()
    assert [r.r for r in got] == list(rows.values())


def test_long_chapter_goes_by_paragraph_and_numbers_run_on(spark):
    text = "Chapter 1\n\n" + "a" * 2000 + "\n\n" + "b" * 2000 + "\nChapter 2\nend"
    got = chunking.chunk_texts(texts(spark, text)).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.chapter_index) for r in got] == [(0, "1/2"), (1, "1/2"), (2, "2/2")]


def test_fallback_has_no_chapter(spark):
    got = chunking.chunk_texts(texts(spark, "one\n\ntwo")).collect()
    assert [(r.text, r.chapter_title, r.chapter_index) for r in got] == [("one\n\ntwo", None, None)]


def test_oversize_table_repeats_its_markers(spark):
    table = "[概述] sum\n[表头]\nlost line\n| h |\n" + "\n".join(f"| {'x' * 20}{i} |" for i in range(8))
    df = texts(spark, table, "no bars\n" * 40, "short")
    got = df.select("doc_id", chunking.split_oversize(F.col("text"), F.lit("table"), 120).alias("p")).orderBy("doc_id").collect()
    assert all(p.startswith("[概述] sum\n[表头]\n|") and "lost line" not in p for p in got[0].p) and len(got[0].p) > 1
    assert len(got[1].p) == 1 and got[2].p == ["short"]


def test_oversize_text_keeps_summary(spark):
    text = "[概述] s\n\n" + "\n\n".join("p" * 50 for _ in range(6))
    got = texts(spark, text).select(chunking.split_oversize(F.col("text"), F.lit("mixed"), 120).alias("p")).first().p
    assert len(got) == 3 and all(p.startswith("[概述] s\n\np") for p in got)


@pytest.mark.parametrize(("answer", "want"), [("x\nregex: ^A$", "^A$"), ("`regex: b`", "b"), ("NONE", None), ("", None), ("^plain$", "^plain$")])
def test_regex_answer(answer, want):
    assert chunking.parse_regex_answer(answer) == want


def test_model_regex_retries_with_the_failed_one():
    asked = []

    def ask(prompt):
        asked.append(prompt)
        return "regex: [" if len(asked) == 1 else "regex: ^【.+】$"

    assert chunking.model_chapter_regex("【a】\nx\n【b】\ny", ask) == "^【.+】$"
    assert "failed: [" in asked[1]
    assert chunking.model_chapter_regex("plain", lambda p: "NONE") is None
    assert chunking.chapters_by("^【.+】$", "pre\n【a】\nx\n【b】\ny") == [("【a】", "【a】\nx"), ("【b】", "【b】\ny")]


def test_pages(spark):
    df = spark.createDataFrame([("d", 1, "a\n b"), ("d", 2, " "), ("d", 3, "| x\n |y"), ("d", 4, "| one"), ("e", 1, "  ")], "doc_id string, page int, text string")
    kinds = {(r.doc_id, r.page): r.k for r in df.select("doc_id", "page", pages.page_type(F.col("text")).alias("k")).collect()}
    assert [kinds["d", i] for i in range(1, 5)] == [pages.TEXT, pages.BLANK, pages.TABLE, pages.TEXT]
    got = pages.batches(df).orderBy("doc_id", "batch").collect()
    assert [(r.doc_id, r.batch, r.first_page, r.last_page) for r in got] == [("d", 0, 1, 3), ("d", 1, 4, 4)]
    assert got[0].text.startswith("[第1页，共4页]  [纯文本]\nL1: a\nL2:  b\n\n[第2页，共4页]  [空白页]\n（本页为空）\n\n")


def test_chapter_map(spark):
    df = spark.createDataFrame([("d", 1, "# One\nx"), ("d", 2, "y"), ("d", 3, " "), ("d", 4, "z" * 250 + "\n# late"), ("d", 5, "## Two\nx"), ("d", 6, "end"), ("d", 7, "")], "doc_id string, page int, text string")
    got = pages.chapter_map(df).orderBy("start").collect()
    assert [(r.start, r.end, r.title) for r in got] == [(1, 4, "One"), (5, 6, "Two")]
    ranges = spark.createDataFrame([("d", 0, 1, 3), ("d", 1, 4, 6)], "doc_id string, batch int, first_page int, last_page int")
    over = pages.chapters_of_batches(ranges, pages.chapter_map(df))
    assert sorted((r.batch, r.title) for r in over.collect()) == [(0, "One"), (1, "One"), (1, "Two")]
    assert "| 1 | 4 | One |" in pages.map_text(over).where("batch = 1").first().text


def test_fetched_page():
    assert pages.fetched_page(1, ["a\nb"]) == "[第1页]\nL1: a\nL2: b"
    assert "超出范围" in pages.fetched_page(2, ["a"]) and "空白" in pages.fetched_page(1, [" "])
