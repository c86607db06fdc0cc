"""Suffix arrays against sorting, and repeats against a table of all windows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from lodestar.llm import suffix_dedup
from lodestar.llm.suffix_array import permuted_lcp, suffix_array


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_array(s):
    sa = suffix_array(s, 3)
    assert sa == sorted(range(len(s)), key=lambda i: s[i:])
    common = permuted_lcp(s, sa)
    for a, b in zip(sa, sa[1:]):
        k = 0
        while k < len(s) - max(a, b) and s[a + k] == s[b + k]:
            k += 1
        assert common[b] == k


@pytest.mark.parametrize("n", [1, 2, 3000])
def test_long_arrays(n):
    rng = random.Random(n)
    for s in ([0] * n, [i % 7 for i in range(n)], [rng.randrange(50) for _ in range(n)]):
        assert suffix_array(s, 49) == sorted(range(n), key=lambda i: s[i:])


def _check(rows, found, least):
    want = brute.repeated([(i, t) for i, t in rows if i is not None and t is not None], least)
    covered = {}
    for r in found:
        assert r.n_words == r.end - r.start >= least
        for at in range(r.start, r.end - least + 1):
            assert (r.doc_id, at) not in covered
            covered[r.doc_id, at] = r.other_id
    assert covered.keys() == want.keys()
    assert all(other == (min(want[i, at]) if want[i, at] else i) for (i, at), other in covered.items())


def _corpus(seed):
    rng = random.Random(seed)
    passages = [brute.prose(rng, n) for n in (12, 13, 30, 200)]
    rows = []
    for i in range(60):
        parts = [brute.prose(rng, rng.randint(0, 80))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            words = p.split(" ")
            lo = rng.randint(0, len(words) // 3)
            parts += [" ".join(words[lo:]) if rng.random() < 0.5 else p, brute.prose(rng, rng.randint(0, 20))]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "b " * 300), (103, passages[3] + " x " + passages[3])]
    return rows


@pytest.mark.parametrize("least, part, array", [(12, 512, 200_000), (12, 16, 50), (30, 40, 300)])
def test_repeats(spark, least, part, array):
    rows = _corpus(least)
    _check(rows, suffix_dedup.repeats(brute.table(spark, rows), least, part, array).collect(), least)


@pytest.mark.parametrize("hot", [1, 8])
def test_hot_anchors(spark, monkeypatch, hot):
    """All or some anchors hot: the rows are the same."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = [*_corpus(12), (5, _corpus(12)[5][1]), (None, _corpus(12)[5][1]), (200, None), (201, "")]
    _check(rows, suffix_dedup.repeats(brute.table(spark, rows), 12).collect(), 12)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    _check(rows, suffix_dedup.repeats(docs).collect(), suffix_dedup.WORDS)


def test_awkward_rows(spark):
    rng = random.Random(9)
    p = brute.prose(rng, 60)
    rows = [(1, p), (2, None), (3, ""), (None, p), (4, "short"), (5, p), (5, p), (6, brute.prose(rng, 30_000)), (7, p + " and more")]
    docs = brute.table(spark, rows, extra=["anchor", "pos", "n", "first", "marks", "shard", "at", "start", "end"])
    _check(rows, suffix_dedup.repeats(docs).collect(), 50)
    assert suffix_dedup.repeats(docs.limit(0)).collect() == []
