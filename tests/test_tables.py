import random

import numpy as np
from pyspark.sql import functions as F

from lodestar.operators import tables


def plain_bounds(rows, min_gap=8, ratio=0.25):
    """Column borders pixel by pixel."""
    low0, high0 = min(b[1] for r in rows for b in r), max(b[3] for r in rows for b in r)
    body = [r for r in rows if not (len(r) == 1 and r[0][3] - r[0][1] >= 0.8 * (high0 - low0))]
    if not body:
        return [low0, high0]
    low, high = min(b[1] for r in body for b in r), max(b[3] for r in body for b in r)
    if high <= low:
        return [low, high]
    cover = [sum(any(b[1] <= x < b[3] for b in r) for r in body) for x in range(low, high)]
    limit, out, x = max(1, int(len(body) * ratio)), [low], 0
    while x < len(cover):
        if cover[x] <= limit:
            end = x
            while end < len(cover) and cover[end] <= limit:
                end += 1
            if end - x >= min_gap:
                out.append((x + low + (high if end == len(cover) else end - 1 + low)) // 2)
            x = end
        else:
            x += 1
    return [*out, high]


def test_bounds_against_pixels():
    rng = random.Random(5)
    for _ in range(200):
        rows = [[("w", x := rng.randint(0, 100), 0, x + rng.randint(0, 50), 10) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 6))]
        assert tables.column_bounds(rows) == plain_bounds(rows)


def test_table(spark):
    words = [(c + str(r), 90, x, r * 20, x + 40, r * 20 + 12) for r in range(1, 5) for c, x in (("a", 0), ("b", 100), ("c", 200))]
    words += [("title", 90, 0, 0, 240, 12), ("low", 10, 0, 40, 40, 52), (" ", 90, 100, 40, 140, 52)]
    df = spark.createDataFrame([("d", 1, i, *w) for i, w in enumerate(words)], "doc_id string, page int, word_no int, value string, confidence int, x1 int, y1 int, x2 int, y2 int")
    cells = tables.tables(df).first().cells
    assert cells[1:] == [[f"a{r}", f"b{r}", f"c{r}"] for r in range(1, 5)]
    assert "title" in cells[0]


def test_single_column():
    assert tables.table_of([("b", 0, 20, 30, 30), ("a", 0, 0, 30, 10)]) == [["a"], ["b"]]
    assert tables.table_of([]) == []


def test_rows_grow_with_their_words():
    rows = tables.cluster_rows([("a", 0, 0, 10, 10), ("b", 20, 5, 30, 15), ("c", 40, 10, 50, 20), ("d", 0, 40, 10, 50)])
    assert [[w[0] for w in r] for r in rows] == [["a", "b", "c"], ["d"]]


def test_numerals():
    w = lambda v, x, y=0, c=90: (v, c, x, y, x + 5, y + 10)
    assert [x[0] for x in tables.merge_numerals([w("I", 0), w("I", 10), w("V", 20), w("x", 30), w("I", 40), w("I", 200)])] == ["II", "V", "x", "I", "I"]
    assert [x[0] for x in tables.merge_numerals([w("", 0), w("V", 10)])] == ["V"]
    assert tables.merge_numerals([w("I", 0, c=80), w("I", 10, c=70)])[0][1:] == (70, 0, 0, 15, 10)


def test_cells_and_headers(spark):
    cells = [[["", "b|"], ["x", " "], ["", ""], ["z", ""]], [["a"]], []]
    df = spark.createDataFrame([(c,) for c in cells], "c array<array<string>>")
    got = df.select(tables.markdown(F.col("c")).alias("m"), tables.header_row(F.col("c")).alias("h"), tables.header_rows(F.col("c")).alias("n")).collect()
    assert got[0].m == "|  | b\\| |\n| x |   |\n|  |  |\n| z |  |"
    assert [(r.h.row, r.h.found, r.n) for r in got] == [(0, True, 2), (0, True, 1), (-1, False, 1)]
    merged = df.limit(1).select(tables.merged_cells(F.col("c"), F.lit(0)).alias("m")).first().m
    assert {k: (v.content, v.merged_from_above) for k, v in merged.items()} == {0: ("x", True)}


def test_content_blocks():
    sums = np.zeros(400)
    sums[100:200] = 50
    sums[390:393] = 50
    assert tables.content_blocks(sums) == (80, 220)
    assert tables.content_blocks([0.0] * 10) == (0, 10)


def test_plain_ocr(spark):
    df = spark.createDataFrame([(["a", " ", "b", "extra"], [0.5, 0.9, 1.0]), ([], [])], "t array<string>, s array<double>")
    got = [r.r for r in df.select(tables.plain_result(F.col("t"), F.col("s")).alias("r")).collect()]
    assert (got[0].text, got[0].avg_confidence) == ("a\nb", 0.75) and (got[1].text, got[1].avg_confidence) == ("", 0.0)
