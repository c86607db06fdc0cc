import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators import assembly
from lodestar.schemas import CHUNK_DEFINITION

DEF = {"chunk_type": "text", "segments": [{"page": 1, "line_range": [1, 2]}]}


@pytest.mark.parametrize("answer", [json.dumps({"chunks": [DEF]}), json.dumps([DEF]), json.dumps([{"chunks": [DEF]}]), "```json\n" + json.dumps({"chunks": [DEF]}) + "\n```", "sure: " + json.dumps({"chunks": [DEF]}) + " done"])
def test_definitions(answer):
    assert assembly.parse_definitions(answer) == [DEF]


def test_no_definitions():
    with pytest.raises(ValueError):
        assembly.parse_definitions("nothing [1, 2]")


def test_definitions_column(spark):
    df = spark.createDataFrame([(json.dumps({"chunks": [DEF]}),), (json.dumps([DEF]),), ("no",)], "a string")
    got = [r.d for r in df.select(assembly.definitions_column(F.col("a")).alias("d")).collect()]
    assert got[0][0].segments[0].line_range == [1, 2] and got[1][0].chunk_type == "text" and got[2] is None


def pages(spark):
    return spark.createDataFrame([("d", 1, "h1\nroi ROE\n\nx"), ("d", 2, "y\nz")], "doc_id string, page int, text string")


def test_assemble(spark):
    rows = [
        ("d", 0, "table", "sum", (1, [1, 9]), [(1, [2, 2]), (2, [1, 9])]),
        ("d", 1, None, None, None, [(1, [3, 3])]),  # blank
        ("d", 2, "text", None, (3, [1]), [(1, [9, 12]), (2, [2, 1]), (2, [2])]),  # nothing valid
        ("d", 3, "text", "", None, [(2, [0, 1])]),
    ]
    defs = spark.createDataFrame([(d, o, (t, s, h, g)) for d, o, t, s, h, g in rows], f"doc_id string, ord int, c {CHUNK_DEFINITION}").select("doc_id", "ord", "c.*")
    got = assembly.assemble(defs, pages(spark)).orderBy("ord").collect()
    assert [(r.ord, r.text) for r in got] == [(0, "[概述] sum\n[表头]\nh1\nroi ROE\ny\nz"), (3, "y")]
    assert got[0].page_nums == [1, 2] and got[0].keywords == ["ROE"] and got[0].length == len(got[0].text) and got[1].type == "text"


def test_coverage_and_ranges(spark):
    segs = spark.createDataFrame([("d", 1, 1, 1), ("d", 1, 5, 9)], "doc_id string, page int, first int, last int")
    missing = assembly.missing_lines(pages(spark), segs)
    assert {(r.page): r.missing for r in missing.collect()} == {1: [2, 4], 2: [1, 2]}
    text = assembly.range_text(assembly.missing_ranges(missing))
    assert {r.page: r.text for r in text.collect()} == {1: "- 第1页: L2, L4", 2: "- 第2页: L1-L2"}


def test_orphans_and_decisions(spark):
    segs = spark.createDataFrame([("d", 1, 1, 1, 0), ("d", 1, 4, 4, 1), ("d", 1, 1, 1, 2)], "doc_id string, page int, first int, last int, chunk int")
    missing = spark.createDataFrame([("d", 1, [2, 3]), ("d", 2, [1])], "doc_id string, page int, missing array<int>")
    got = assembly.orphans(missing, segs)
    assert sorted((r.page, r.line, r.before, r.after) for r in got.collect()) == [(1, 2, 0, 1), (1, 3, 0, 1), (2, 1, None, None)]
    chunks = spark.createDataFrame([("d", 0, "a" * 400), ("d", 1, "b" * 400)], "doc_id string, chunk long, text string")
    row = assembly.orphan_context(got, chunks, pages(spark)).where("page = 1 and line = 2").first()
    assert (row.text, len(row.context_before), len(row.context_after)) == ("roi ROE", 300, 300)
    fixes = spark.createDataFrame([("d", 1, 2, "merge_before"), ("d", 1, 3, "standalone"), ("d", 2, 1, "merge_after")], "doc_id string, page int, line int, action string")
    assert sorted((r.page, r.line, r.chunk) for r in assembly.decide(fixes, got).collect()) == [(1, 2, 0), (1, 3, None), (2, 1, None)]


@pytest.mark.parametrize(("page", "line", "want"), [(1, 3, [(1, [1, 3]), (2, [5, 6])]), (2, 4, [(1, [1, 2]), (2, [4, 6])]), (1, 9, [(1, [1, 2]), (1, [9, 9]), (2, [5, 6])])])
def test_extend(spark, page, line, want):
    df = spark.createDataFrame([([(1, [1, 2]), (2, [5, 6])],)], "s array<struct<page:int,line_range:array<int>>>")
    got = df.select(assembly.extend_segments(F.col("s"), F.lit(page), F.lit(line)).alias("s")).first().s
    assert [(x.page, x.line_range) for x in got] == want


def test_in_batch(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 4],)], "p array<int>")
    assert [r[0] for r in df.select(assembly.in_batch(F.col("p"), F.array(*map(F.lit, (1, 2, 3))))).collect()] == [True, False]
