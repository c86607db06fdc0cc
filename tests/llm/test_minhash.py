"""Signatures against weighted Jaccard, and near pairs against all pairs."""

import random

import numpy as np
import pyarrow as pa

import brute
from lodestar.llm import minhash
from lodestar.llm.components import components
from lodestar.llm.hashing import U, mix


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    m, n = 1024, 12
    for high in (1, 2, 9, 70):
        errors = []
        for trial in range(n):
            x = mix(np.arange(60, dtype=U) + U(1000 * trial))
            a, b = rng.integers(0, high + 1, 60), rng.integers(0, high + 1, 60)
            b = np.where(rng.random(60) < 0.6, a, b)
            both = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
            sig = minhash.signatures(both, np.concatenate([x[a > 0], x[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, m)
            errors.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
        assert max(map(abs, errors)) < 0.08 and abs(np.mean(errors)) < 0.02


def test_a_bag_alone_has_the_same_signature():
    x, w = mix(np.arange(40, dtype=U)), np.arange(40) % 5 + 1
    alone = minhash.signatures(np.zeros(40, int), x, w, 1, 128)
    other = mix(np.arange(500, 900, dtype=U))
    both = minhash.signatures(np.concatenate([np.zeros(40, int), np.ones(400, int)]), np.concatenate([x, other]), np.concatenate([w, np.ones(400, int)]), 2, 128)
    assert (alone[0] == both[0]).all()


def _corpus(seed, n=25):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = brute.prose(rng, rng.choice([3, 12, 60, 200])).split(" ")
        rows.append((i, " ".join(words)))
        for j in range(rng.randint(0, 4)):
            copy = [f"e{rng.random()}" if rng.random() < rng.choice([0, 0.02, 0.06]) else w for w in words]
            rows.append((1000 + 10 * i + j, "  ".join(copy) if j % 2 else "\n".join(copy)))
    return rows


def _check(rows, found):
    want = brute.near(rows)
    for r in found:
        assert r.near_doc_id < r.doc_id and abs(r.jaccard - want[r.near_doc_id, r.doc_id]) < 1e-9
    linked = brute.groups([(r.near_doc_id, r.doc_id) for r in found])
    held = [linked.get(a, a) == linked.get(b, b) for a, b in want]
    assert sum(held) >= 0.9 * len(held)
    return want


def test_near_copies(spark):
    rows = _corpus(1)
    want = _check(rows, minhash.near_copies(brute.table(spark, rows)).collect())
    assert len(want) > 30


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert _check([(r.doc_id, r.text) for r in docs.collect()], minhash.near_copies(docs).collect())


def test_awkward_rows(spark):
    rng = random.Random(4)
    long = brute.prose(rng, 30_000)
    rows = [(1, "a b c d"), (1, "other words here"), (2, "other words here"), (3, None), (4, ""), (5, " \n"), (6, ""), (None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (8, "one"), (9, "one"), (10, long), (11, long + " end")]
    docs = brute.table(spark, rows, extra=["band", "a", "b", "left", "right", "jaccard", "root", "node"])
    found = sorted((r.doc_id, r.near_doc_id) for r in minhash.near_copies(docs).collect())
    assert found == [(2, 1), (7, 1), (9, 8), (11, 10)]
    kept = minhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    gone = {2, 7, 9, 11}
    key = lambda r: str(tuple(r))
    assert sorted(kept.collect(), key=key) == sorted([r for r in docs.collect() if r.doc_id not in gone], key=key)
    assert minhash.near_copies(docs.limit(0)).collect() == [] == minhash.without_near_copies(docs.limit(0)).collect()


def test_unlike_documents_of_one_bucket(spark):
    """With a single row a band, buckets hold documents that aren't near their first: the later rounds compare them all the same."""
    rng = random.Random(8)
    stock = [brute.prose(rng, 30) for _ in range(6)]
    rows = [(i, " ".join(rng.sample(stock, 3))) for i in range(40)]
    want = brute.near(rows)
    found = minhash.near_pairs(brute.table(spark, rows), rows=1, bands=64).collect()
    assert {(r.a, r.b) for r in found} <= want.keys()
    assert brute.groups([(r.a, r.b) for r in found]) == brute.groups(want)


def test_near_one_later_member_only(spark):
    """80 smaller ids are near b and take it out of every bucket; c is near b alone and is linked all the same."""
    rng = random.Random(9)
    unit = [brute.prose(rng, 20, 100_000) for _ in range(54)]
    b, c = list(range(48)), [*range(10, 48), *range(48, 54)]
    rows = [(i, " ".join(unit[u] for u in sorted(rng.sample(b[:10], 6) + rng.sample(b[10:], 22)))) for i in range(80)]
    rows += [(100, " ".join(unit[u] for u in b)), (101, " ".join(unit[u] for u in c))]
    want = brute.near(rows)
    assert {a for a, d in want if d == 101} == {100} and sum(d == 100 for _, d in want) > 40
    found = minhash.near_pairs(brute.table(spark, rows)).collect()
    assert {(r.a, r.b) for r in found} <= want.keys() and len(found) == len({(r.a, r.b) for r in found})
    assert brute.groups([(r.a, r.b) for r in found]) == brute.groups(want)


def test_one_document_left_in_a_bucket(spark):
    """A, b and c alone in a bucket, b near both: c, the only one that A leaves over, is compared with b."""
    rng = random.Random(10)
    rows = []
    for i in range(0, 300, 10):
        unit = [brute.prose(rng, 20, 100_000) for _ in range(17)]
        rows += [(i, " ".join(unit[:10])), (i + 1, " ".join(unit[3:13])), (i + 2, " ".join(unit[5:15]))]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    band = {i: h for out in minhash._bands([batch], 1, 1) for h, i in zip(*(c.to_pylist() for c in out.columns))}
    want = {p for p in brute.near(rows) if band[p[0]] == band[p[1]]}
    assert any({(i, i + 1), (i + 1, i + 2)} <= want for i in range(0, 300, 10))
    found = {(r.a, r.b) for r in minhash.near_pairs(brute.table(spark, rows), rows=1, bands=1).collect()}
    assert found == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == brute.groups(edges)


def _families(rng, n, first=0):
    """n families of three texts in which only the neighbours are near, all of them in the bucket of one shared word pair."""
    rows = []
    for i in range(n):
        unit = [brute.prose(rng, 20, 100_000) for _ in range(17)]
        rows += [(first + i, " ".join(unit[:10])), (first + n + i, " ".join(unit[3:13])), (first + 2 * n + i, " ".join(unit[5:15]))]
    return rows


def _one_bucket(monkeypatch):
    def one(batches, bands, rows):
        for batch in batches:
            ids = [i for i, t in zip(*(c.to_pylist() for c in batch.columns)) if t.split()]
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(ids), pa.int64()), pa.array(ids, pa.int64())], names=["band", "doc_id"])

    monkeypatch.setattr(minhash, "_bands", one)


def test_a_large_bucket_of_many_families(spark, monkeypatch):
    """60 families in one bucket of 180 members: the rounds by first members end long before they are through."""
    _one_bucket(monkeypatch)
    rows = _families(random.Random(13), 60)
    want = brute.near(rows)
    for size in (1024, 20):
        monkeypatch.setattr(minhash, "BLOCK_ROWS", size)
        found = minhash.near_pairs(brute.table(spark, rows)).collect()
        assert {(r.a, r.b) for r in found} <= want.keys() and all(abs(r.jaccard - want[r.a, r.b]) < 1e-9 for r in found)
        assert brute.groups([(r.a, r.b) for r in found]) == brute.groups(want) and len(brute.groups(want)) >= 60


def test_copies_in_a_large_bucket(spark, monkeypatch):
    """Families whose texts have copies each, under other ids, and a doc_id whose second row is blank."""
    _one_bucket(monkeypatch)
    rows = _families(random.Random(14), 25)
    rows += [(1000 + 100 * c + i, t) for c in range(2) for i, t in rows] + [(5000, rows[7][1]), (5000, " "), (5001, ""), (5002, None), (None, rows[0][1])]
    got = {r.doc_id: r.class_id for r in minhash.near_classes(brute.table(spark, rows)).collect()}
    linked = brute.groups(brute.near(rows))
    assert got == {i: linked.get(i, i) for i, _ in rows if i is not None}
    assert minhash.near_classes(brute.table(spark, [])).collect() == []
