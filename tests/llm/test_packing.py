"""Best-two-fit against the rule word for word, and bins that hold every token once."""

import random
from collections import defaultdict

import pytest

import brute
from lodestar.llm import packing
from lodestar.llm.vocabulary import encoding


@pytest.mark.parametrize("seed", range(30))
def test_rule(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 100])
    pieces = [(rng.randint(1, capacity), (False, i, 0)) for i in range(rng.randint(0, 60))]
    bins = packing.best_two_fit(pieces, capacity)
    assert [[s for s, _ in b] for b in bins] == brute.naive_best_two_fit(pieces, capacity)
    assert sorted(x for b in bins for x in b) == sorted(pieces)


def test_two_replace_the_smallest():
    assert [[s for s, _ in b] for b in packing.best_two_fit([(s, (False, i, 0)) for i, s in enumerate([6, 3, 2, 2])], 10)] == [[6, 2, 2], [3]]


def _covers(rows, bins, capacity):
    want = {}
    for i, t in rows:
        if t:
            want[i] = want.get(i, 0) + len(encoding().encode_ordinary(t))
    got = defaultdict(int)
    for b in bins:
        assert b.used == sum(b.sizes) <= capacity and b.n_docs == len(b.doc_ids) == len(b.starts)
        for i, size in zip(b.doc_ids, b.sizes):
            got[i] += size
    assert dict(got) == want


def test_every_token_once(spark):
    rng = random.Random(5)
    rows = [(i, brute.prose(rng, rng.choice([1, 5, 40, 300]))) for i in range(120)] + [(200, brute.prose(rng, 20_000)), (201, None), (202, ""), (None, "nameless text"), (203, "same"), (203, "same")]
    docs = brute.table(spark, rows, extra=["size", "shard", "bin", "start"])
    bins = packing.pack(docs, capacity=256).collect()
    _covers(rows, bins, 256)
    key = lambda b: (b.shard, b.bin, b.doc_ids, b.starts, b.sizes)
    again = packing.pack(docs.drop("size", "shard", "bin", "start").repartition(7), capacity=256).collect()
    assert sorted(map(key, bins), key=str) == sorted(map(key, again), key=str)
    sharded = packing.pack(docs, capacity=256, shard=4096).collect()
    _covers(rows, sharded, 256)
    assert len({b.shard for b in sharded}) > 3
    for s in {b.shard for b in sharded}:  # each shard is packed by the rule
        pieces = [(n, (i is None, i or 0, at)) for b in sharded if b.shard == s for i, at, n in zip(b.doc_ids, b.starts, b.sizes)]
        assert [list(b.sizes) for b in sorted(sharded, key=lambda b: b.bin) if b.shard == s] == brute.naive_best_two_fit(pieces, 256)


def test_nothing(spark):
    assert packing.pack(brute.table(spark, [(1, None), (2, "")])).collect() == []
    assert packing.pack(brute.table(spark, [])).collect() == []
