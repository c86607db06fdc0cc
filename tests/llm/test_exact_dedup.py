"""Exact dedup against SQL, with a digest that collides, and over several batches."""

import duckdb
import pytest
from pyspark.sql import functions as F

from brute import table
from lodestar.llm import exact_dedup

ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None), (6, ""), (7, ""), (8, "A"), (9, "a "), (10, "ab"), (11, "a"), (12, "x" * 500_000), (13, "x" * 500_000), (14, "x" * 499_999 + "y")]


def _expected(rows):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is not None and t in first:
            out.append((i, first[t]))
        elif t is not None:
            first[t] = i
    return sorted(out, key=str)


def _pairs(df):
    return sorted(((r.doc_id, r.duplicate_of) for r in df.collect()), key=str)


def test_against_sql(spark, tmp_path):
    docs = table(spark, ROWS)
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/d/*.parquet'")
    want = sorted(db.execute(exact_dedup.ORACLE).fetchall(), key=str)
    assert _pairs(exact_dedup.exact_copies(docs)) == want == _expected(ROWS)


def test_full_bytes_decide(spark):
    weak = lambda text: F.encode(F.substring(text, 1, 1), "utf-8")
    assert _pairs(exact_dedup.exact_copies(table(spark, ROWS), digest=weak)) == _expected(ROWS)


def test_batches_share_the_state(spark, tmp_path):
    for k, rows in enumerate((ROWS[:6], ROWS[6:], [(20, "b"), (21, "new"), (22, "ab")])):
        table(spark, rows).write.parquet(f"{tmp_path}/b{k}")
    state = exact_dedup.ExactDedup(spark, f"file://{tmp_path}/state")
    found = [_pairs(state.copies(spark.read.parquet(f"{tmp_path}/b{k}")).select("doc_id", "duplicate_of")) for k in range(3)]
    assert found[0] == [(3, 1)]
    assert found[1] == sorted([(7, 6), (11, 1), (13, 12)], key=str)
    assert found[2] == [(20, 2), (22, 10)]


WEAK = lambda text: F.encode(F.substring(text, 1, 1), "utf-8")


@pytest.mark.parametrize("files", [True, False])
def test_a_retry_and_batches_with_and_without_files(spark, tmp_path, files):
    """A batch taken in again under its name gives the rows it gave, also after a later batch; batches need not come from files."""
    batches = {"one": [(1, "a"), (2, "b"), (None, "n"), (3, "a"), (4, None)], "two": [(5, "b"), (6, "n"), (7, "new"), (8, "new")], "three": [(9, "new"), (10, "a"), (None, "b")]}
    want = {"one": [(3, 1)], "two": [(5, 2), (6, None), (8, 7)], "three": [(9, 7), (10, 1), (None, 2)]}
    state = exact_dedup.ExactDedup(spark, f"file://{tmp_path}/state")
    for name in ("one", "one", "two", "three", "one", "two"):
        docs = table(spark, batches[name])
        if files:
            docs.write.mode("ignore").parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert _pairs(state.copies(docs, name)) == sorted(want[name], key=str), name


def test_a_digest_that_collides_over_batches(spark, tmp_path):
    """Later texts of a digest are held too: a copy of any of them is found, in whichever batch it comes."""
    state = exact_dedup.ExactDedup(spark, f"file://{tmp_path}/state", WEAK)
    for k, (rows, want) in enumerate([([(1, "ax"), (2, "ay")], []), ([(3, "ay"), (4, "az"), (5, "ax")], [(3, 2), (5, 1)]), ([(6, "az"), (7, "aw")], [(6, 4)]), ([(8, "aw"), (9, "az"), (10, "ay")], [(8, 7), (9, 4), (10, 2)])]):
        assert _pairs(state.copies(table(spark, rows), f"b{k}")) == sorted(want, key=str)


def test_text_that_is_made_on_the_way_is_found_again(spark, tmp_path):
    """Files hold other texts than the batch does: the place of the content is in the state's folder."""
    table(spark, [(1, "A"), (2, "B")]).write.parquet(f"{tmp_path}/b")
    docs = spark.read.parquet(f"{tmp_path}/b").withColumn("text", F.lower("text"))
    state = exact_dedup.ExactDedup(spark, f"file://{tmp_path}/state")
    assert _pairs(state.copies(docs, "b0")) == []
    assert _pairs(state.copies(table(spark, [(3, "a"), (4, "B")]), "b1")) == [(3, 1)]


def test_a_batch_without_texts(spark, tmp_path):
    state = exact_dedup.ExactDedup(spark, f"file://{tmp_path}/state")
    assert _pairs(state.copies(table(spark, [(1, None)]), "b0")) == [] == _pairs(state.copies(table(spark, []), "b1"))
    assert _pairs(state.copies(table(spark, [(2, "a"), (3, "a")]), "b2")) == [(3, 2)]


def test_repeated_and_nameless_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, None), (None, "n"), (None, "n"), (3, "z")]
    assert _pairs(exact_dedup.exact_copies(table(spark, rows))) == _expected(rows)
    kept = [(r.doc_id, r.text) for r in exact_dedup.without_copies(table(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a"), (None, None), (None, "n"), (3, "z")], key=str)


def test_filter_keeps_rows_whole(spark):
    names = ["doc", "print", "_print", "row", "number", "digest", "batch", "first", "n", "file", "duplicate_of", "k"]
    docs = table(spark, ROWS, extra=names)
    gone = {i for i, _ in _expected(ROWS)}
    got = exact_dedup.without_copies(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id not in gone)
    assert exact_dedup.exact_copies(docs.limit(0)).collect() == [] == exact_dedup.without_copies(docs.limit(0)).collect()
