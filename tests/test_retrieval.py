import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.config import Config
from lodestar.operators import context, gaps, rerank, retrieval


def test_bm25_by_hand(spark):
    docs = {1: "a b a", 2: "b c", 3: "", 4: "d"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.score for r in retrieval.bm25(df, spark.createDataFrame([(0, "A, b!")], "query_id long, text string")).collect()}
    toks = {k: v.split() for k, v in docs.items()}
    avg = sum(map(len, toks.values())) / 4
    want = {}
    for t in ("a", "b"):
        df_t = sum(t in v for v in toks.values())
        idf = math.log(1 + (4 - df_t + 0.5) / (df_t + 0.5))
        for k, v in toks.items():
            if tf := Counter(v)[t]:
                want[k] = want.get(k, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(v) / avg))
    assert got == pytest.approx(want, abs=1e-6)


def test_nearest_against_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, vector array<double>")
    got = retrieval.nearest(df, df.withColumnRenamed("doc_id", "query_id"), 5, block=16).collect()
    scores = np.round(v @ v.T, 6)
    for q in range(60):
        mine = sorted((r.rank, r.doc_id) for r in got if r.query_id == q)
        assert [d for _, d in mine] == sorted(range(60), key=lambda d: (-scores[q, d], d))[:5]


def test_lsh_finds_most(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, vector array<double>")
    exact = {(r.query_id, r.doc_id) for r in retrieval.nearest(df, df.withColumnRenamed("doc_id", "query_id"), 3).collect()}
    near = {(r.query_id, r.doc_id) for r in retrieval.near_bucketed(df, df.withColumnRenamed("doc_id", "query_id"), 3).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "query_id long, doc_id long, rank int")
    one, two = (sorted((r.rank, r.doc_id, r.hybrid_score) for r in retrieval.fuse(*x).collect()) for x in ((a, b), (b, a)))
    assert one == two and [d for _, d, _ in one] == [2, 1, 3]


def test_tri_state(spark):
    store = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    files = lambda *rows: spark.createDataFrame(list(rows), "file_md5 string, is_enabled boolean")
    assert retrieval.allowed(store, files()).count() == 2
    assert retrieval.allowed(store, files(("a", False))).count() == 0
    assert retrieval.allowed(store, files(("a", True), ("b", False))).count() == 1


def test_han_pairs(spark):
    df = spark.createDataFrame([("资产负债 ROE",)], "t string")
    assert df.select(retrieval.tokens(F.col("t"), True)).first()[0] == ["资产", "产负", "负债", "roe"]


@pytest.mark.parametrize(("scores", "kept"), [([9, 8, 8, 9, 8, 4, 3, 2], 5), ([8, 8, 8, 9, 7, 7, 7, 6, 3, 2], 7), ([6, 5, 5, 4, 4, 3], 3), ([4, 3, 2, 1, 0, 0], 0), ([8, 8, 7, 7], 4)])
def test_sieve(spark, scores, kept):
    rows = spark.createDataFrame([(0, i, s) for i, s in enumerate(scores)], "query_id long, doc_id long, llm_score int")
    assert rerank.sieve(rows).count() == kept


def test_align(spark):
    rows = spark.createDataFrame([(0, 1), (0, 2)], "query_id long, doc_id long")
    scores = spark.createDataFrame([(0, 1, 9, "x", 0), (0, 1, 3, "y", 1), (0, 7, 9, "z", 2)], "query_id long, doc_id long, score int, reason string, ord int")
    got = {r.doc_id: (r.llm_score, r.llm_reason) for r in rerank.align(rows, scores).collect()}
    assert got == {1: (3, "y"), 2: (-1, rerank.MISSING)}


def test_rerank_is_stable(spark):
    rows = spark.createDataFrame([(0, i, i + 1, s) for i, s in enumerate([0.5, None, 0.9, 0.5])], "query_id long, doc_id long, rank int, cross_encoder_score double")
    assert [r.doc_id for r in rerank.rerank(rows, 3).orderBy("ce_rank").collect()] == [2, 0, 3]


def plain_fill(cands, lengths, cfg):
    """The budgets kept step by step."""
    rows = sorted(cands)
    most, room, n = int(len(rows) * cfg.gap_fill_ratio + 0.9999), int(cfg.gap_tokens / 0.6), 0
    chosen, order = set(rows), []
    for a, b in zip(rows, rows[1:] + [None]):
        order.append(a)
        if b and a[0] == b[0] and 1 <= b[1] - a[1] - 1 <= cfg.gap_fill_width:
            for i in range(a[1] + 1, b[1]):
                k = (a[0], i)
                if n < most and k in lengths:
                    if lengths[k] > room:
                        break
                    room, n = room - lengths[k], n + 1
                    chosen.add(k)
                    order.append(k)
    for d, i in order:
        for s in [-x for x in range(1, cfg.neighbor_width + 1)] + list(range(1, cfg.neighbor_width + 1)):
            k = (d, i + s)
            if n < most and k in lengths and k not in chosen:
                if lengths[k] > room:
                    break
                room, n = room - lengths[k], n + 1
                chosen.add(k)
    return chosen


def test_gaps_against_model(spark):
    rng = random.Random(2)
    cfg = Config(gap_fill_width=2, neighbor_width=2, gap_tokens=300)
    store = [("d" + str(d), i, rng.randint(10, 200)) for d in range(4) for i in range(12) if rng.random() < 0.9]
    lengths = {(d, i): n for d, i, n in store}
    cands = {q: [k for k in lengths if rng.random() < 0.25] for q in range(20)}
    df = spark.createDataFrame([(q, *k) for q, ks in cands.items() for k in ks], "query_id long, doc_id string, chunk_index int")
    got = gaps.fill(df, spark.createDataFrame(store, "doc_id string, chunk_index int, length int"), cfg).collect()
    for q, ks in cands.items():
        assert {(r.doc_id, r.chunk_index) for r in got if r.query_id == q} == (plain_fill(ks, lengths, cfg) if ks else set())


@pytest.mark.parametrize(("cands", "want"), [([0, 2], [0, 1, 2]), ([1, 3, 5], [1, 2, 3, 4, 5]), ([0, 9], [0, 9])])
def test_gap_only(cands, want):
    cfg = Config(neighbor_width=0)
    lengths = {("d", i): 10 for i in range(10)}
    assert [k[1] for k, _ in gaps.admitted([("d", i) for i in cands], lengths, cfg)] == want


def test_gap_ratio():
    got = gaps.admitted([("d", i) for i in (1, 3, 5, 7)], {("d", i): 1 for i in range(9)}, Config(neighbor_width=0, gap_fill_ratio=0.5))
    assert sum(o == "gap" for _, o in got) == 2


@pytest.mark.parametrize(("parts", "limit", "want"), [(["aa", "bb"], 1, ["aa", "bb"]), (["a", "b", "c"], 100, ["a", "b", "c"]), (["aaaa", "bbbb", "cccc", "dddd"], 11, ["aaaa", "…", "dddd"]), (["a" * 9, "b", "c" * 9], 5, ["a" * 9, "…", "c" * 9])])
def test_trim(parts, limit, want):
    assert context.trimmed(parts, limit) == want


def test_contexts(spark):
    rows = [(0, "d", "", [3], "ch", 5, "t5"), (0, "d", "name", [], "", 4, "t4")]
    df = spark.createDataFrame(rows, "query_id long, doc_id string, doc_name string, page_nums array<int>, chapter_title string, chunk_index int, text string")
    assert context.contexts(df).first().context == "--- 文档片段 1 (来源: name, chunk #4) ---\nt4\n\n--- 文档片段 2 (来源: d, 页码 [3], 章节 ch, chunk #5) ---\nt5"


def test_history_numbers_after_cutting(spark):
    kind = "t array<struct<query:string,answer:string,sources:array<struct<doc_name:string,page_nums:array<int>,chunk_index:int,chapter_title:string>>>>"
    df = spark.createDataFrame([([(f"q{i}", f"a{i}", []) for i in range(7)],), ([],), (None,)], kind)
    got = [r[0] for r in df.select(context.history(F.col("t"))).collect()]
    assert got[0].startswith("[历史对话]\n历史问答 1:\n  问题: q2") and got[0].endswith("参考文档: 无\n---") and got[1:] == ["", ""]


@pytest.mark.parametrize("bad", [{"score_tiers": (5, 5)}, {"score_tiers": (11,)}, {"score_tiers": ()}, {"audit_rows": 0}, {"gap_fill_width": -1}, {"neighbor_width": 1.5}])
def test_config(bad):
    with pytest.raises(ValueError):
        Config(**bad)
