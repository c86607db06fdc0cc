"""What Python holds at once of the rows that Spark sends doesn't grow with the batch."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.functions.arrow import pieces
from lodestar.operators import chunking, context, gaps, retrieval, tables

N = 3000


def test_pieces_are_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"x": list(range(N)), "t": ["a" * 5000] * N})
    got = list(pieces(batch))
    assert [x for p in got for x in p.column(0).to_pylist()] == list(range(N)) and max(map(len, got)) <= 256 and max(p.nbytes for p in got) <= 1 << 20
    assert [len(p) for p in pieces(pa.array([], pa.string()))] == [0]


def _given(monkeypatch, spark, make):
    """The function that `make` hands to Spark."""
    held = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, f, schema: held.append(f) or df)
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: held.append(f) or (lambda *columns: columns[0]))
    make()
    return held[0]


def _cases(spark):
    text = pa.array(["a\nb"] * N)
    ids = pa.array(range(N))
    words = pa.array([[{"word_no": 1, "value": "w", "confidence": 90, "x1": 0, "y1": 0, "x2": 9, "y2": 9}]] * N)
    rows = pa.array([[{"doc_id": 1, "chunk_index": 0, "length": 5, "mine": True}]] * N)
    store = spark.createDataFrame([(1, 1, 0)], "query_id long, doc_id long, chunk_index int")
    boxes = spark.createDataFrame([], "doc_id long, page int, word_no int, value string, confidence int, x1 int, y1 int, x2 int, y2 int")
    return {
        "F3": (lambda: gaps.fill(store, store.selectExpr("doc_id", "chunk_index", "5 as length")), pa.RecordBatch.from_arrays([ids, rows], ["query_id", "rows"])),
        "F4": (lambda: context.trim(F.col("p"), limit=9), pa.array([["a", "b"]] * N)),
        "F6": (lambda: tables.tables(boxes), pa.RecordBatch.from_arrays([ids, pa.array([1] * N, pa.int32()), words], ["doc_id", "page", "words"])),
        "F7": (lambda: chunking.split_oversize(F.col("t"), F.lit("text"), 2, "\n"), (text, text)),
        "chunks": (lambda: chunking.paragraph_chunks(F.col("t"), 2, "\n"), text),
    }


@pytest.mark.parametrize("name", ["F3", "F4", "F6", "F7", "chunks"])
def test_a_batch_is_done_in_pieces(monkeypatch, spark, name):
    make, batch = _cases(spark)[name]
    got = [len(x) for x in _given(monkeypatch, spark, make)(iter([batch]))]
    assert sum(got) == N and max(got) <= 256


def test_terms_are_looked_up_in_pieces(monkeypatch):
    """Of a batch of 3000 documents at most LOOKED are looked up at once; the counts are those of all."""
    asked = retrieval._Asked(pa.table({"query_id": [1, 1], "term": ["a", "b"]}))
    seen, plain = [], asked.postings
    monkeypatch.setattr(asked, "postings", lambda t: seen.append(len(t)) or plain(t))
    batch = pa.RecordBatch.from_arrays([pa.array(range(N)), pa.array([2] * N, pa.int32()), pa.array([["a", "c"]] * N)], ["doc_id", "dl", "t"])
    (out,) = asked.counted(iter([batch]))
    assert dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist())) == {0: N, -1: N, -2: 2 * N}
    assert max(seen) <= retrieval.LOOKED and sum(seen) == N


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_nearest_of_single_precision_are_those_of_double(kind):
    """Vectors that differ by less than single precision tells, ties among them, and values that aren't finite."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    all_ = np.concatenate([base + 1e-7 * rng.normal(size=base.shape) for _ in range(60)]).astype(kind).astype(np.float64)
    all_[7] = np.nan
    asked, ids = all_[::50].copy(), rng.permutation(len(all_))
    found = retrieval._Nearest(asked, 42)
    for at in range(0, len(all_), 100):
        found.add(all_[at : at + 100], ids[at : at + 100])
    got = [r for b in found.rows(pa.array(range(len(asked))), pa.int64()) for r in zip(*(c.to_pylist() for c in b.columns))]
    scores = np.round(np.einsum("ik,jk->ij", asked, all_), 6)
    want = [(q, int(ids[x]), scores[q, x]) for q in range(len(asked)) for x in np.lexsort((ids, -scores[q]))[:42]]
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-9)


def test_many_blocks_of_queries_are_asked_in_few_tasks(spark):
    """Each task gives the k best of each query: with 50 blocks these don't grow with the partitions of the store."""
    store = spark.range(200).selectExpr("id as doc_id", "array(double(id), 1.0) as vector").repartition(40)
    found = retrieval.nearest(store, store.withColumnRenamed("doc_id", "query_id"), k=3, block=4)
    assert found.count() == 600
    spread = len(list(retrieval._in_blocks(store.selectExpr("doc_id as query_id", "vector"), 64)))
    assert spread == 4
