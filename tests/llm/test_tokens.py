"""Prefix counts, and encoding by halves, against the tokenizer itself."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from lodestar.llm import bpe, token_counts
from lodestar.llm.vocabulary import encoding

MULTI = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
TEXTS = ["", " ", "a", "Hello, world!  It's they'll  we're\n\n  done.", "  lead", "x" * 300, "naïve café Straße ÀÖ ǅ", "日本語のテキスト 😀😀 emoji", "a b   c\x0b\x0cd", "1234 5678  9", "'s 't 're 've 'm 'll 'd 'S", "== != <= ->>> \t\t x", "\u0085  x", "é combining", "tab\t\tnew\n\n\nline  ", "don''t '' 'rex 'vex"]
WORDS = st.text(alphabet=st.sampled_from(list("ab Z'sntremvld10\n\t .,!é日😀 ")), max_size=60)


def _prefixes(text, path):
    return [len(encoding(path).encode_ordinary(text[:i])) for i in range(len(text) + 1)]


@pytest.mark.parametrize("path", [token_counts.PATH, MULTI])
@pytest.mark.parametrize("text", TEXTS)
def test_prefixes(text, path):
    assert token_counts.counter(path).prefixes(text).tolist() == _prefixes(text, path)


@settings(max_examples=300, deadline=None)
@given(WORDS)
def test_prefixes_of_any_text(text):
    assert token_counts.counter().prefixes(text).tolist() == _prefixes(text, token_counts.PATH)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_prefixes_of_any_characters(text):
    assert token_counts.counter().prefixes(text).tolist() == _prefixes(text, token_counts.PATH)


@settings(max_examples=300, deadline=None)
@given(WORDS, st.integers(1, 12))
def test_halves(text, leaf):
    tokens = bpe.encode(text, leaf=leaf)
    assert tokens == encoding().encode_ordinary(text)
    assert bpe.decode(tokens, leaf=leaf) == text.encode()


@pytest.mark.parametrize("path", [bpe.PATH, MULTI])
@pytest.mark.parametrize("text", [*TEXTS, "a" * 5000, " " * 3000 + "b", "ab " * 4000])
def test_halves_of_hard_texts(text, path):
    for leaf in (1, 7, 8192):
        assert bpe.encode(text, path, leaf) == encoding(path).encode_ordinary(text)


DENSE = ["日本語文字処理漢字" * 12, "中" * 130, "𝔘𝔫𝔦" * 60, "😀🤖🧬" * 34, "🏳️‍🌈" * 60, "é́̂" * 100, "한국어" * 100, "ก็" * 130, "a" + "́" * 300]


@pytest.mark.parametrize("text", DENSE)
def test_parts_of_more_tokens_than_a_byte_counts(text):
    """Scripts without white space: one part of 100 to 400 characters has more tokens than characters."""
    for whole in (text, f"before {text}  after {text}", text[:100]):
        assert token_counts.counter().prefixes(whole).tolist() == _prefixes(whole, token_counts.PATH)


def test_dense_rows(spark):
    rows = list(enumerate(DENSE))
    got = {r.doc_id: (r.n_tokens, r.prefix_tokens) for r in token_counts.token_counts(brute.table(spark, rows)).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: len(encoding().encode_ordinary(t)) for i, t in rows}
    assert all(len(p) == len(t) + 1 and p[-1] == n for (i, t), (n, p) in zip(rows, (got[i] for i, _ in rows)))


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {i: encoding().encode_ordinary(t) for i, t in texts.items()}
    rows = bpe.encode_documents(docs).collect()
    assert {r.doc_id: r.tokens for r in rows} == want and all(r.decoded == texts[r.doc_id] and r.n_tokens == len(r.tokens) for r in rows)
    counted = {r.doc_id: r for r in token_counts.token_counts(docs).collect()}
    assert {i: r.n_tokens for i, r in counted.items()} == {i: len(t) for i, t in want.items()}
    rng = random.Random(3)
    for i, t in texts.items():
        for at in rng.sample(range(len(t) + 1), min(3, len(t) + 1)):
            assert counted[i].prefix_tokens[at] == len(encoding().encode_ordinary(t[:at]))


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, "long text, " * 40_000)]
    docs = brute.table(spark, rows, extra=["tokens", "n_tokens", "decoded", "prefix_tokens"])
    want = sorted([(i, None if t is None else len(encoding().encode_ordinary(t))) for i, t in rows], key=str)
    counted, coded = token_counts.token_counts(docs).collect(), bpe.encode_documents(docs).collect()
    assert sorted([(r.doc_id, r.n_tokens) for r in counted], key=str) == want == sorted([(r.doc_id, r.n_tokens) for r in coded], key=str)
    assert {r.doc_id: r.prefix_tokens for r in counted if r.doc_id in (1, 2)} == {1: None, 2: [0]}
    assert {r.doc_id: r.decoded for r in coded if r.doc_id in (1, 2, 3)} == {1: None, 2: "", 3: "a b"}
    assert token_counts.token_counts(docs.limit(0)).collect() == [] == bpe.encode_documents(docs.limit(0)).collect()


def test_budgets(spark):
    text = "Hello, world! It's a longer text."
    counted = token_counts.token_counts(brute.table(spark, [(1, text)]))
    full = _prefixes(text, token_counts.PATH)
    row = counted.select(*[token_counts.longest_prefix(F.col("prefix_tokens"), b).alias(f"b{b}") for b in range(12)], token_counts.tokens_before(F.col("prefix_tokens"), F.lit(5)).alias("five")).first()
    assert row.five == full[5]
    for b in range(12):
        assert row[f"b{b}"] == max(i for i, n in enumerate(full) if n <= b)


def test_arguments_that_nothing_fits(spark):
    counted = token_counts.token_counts(brute.table(spark, [(1, "a b c"), (2, ""), (3, None)]))
    p = F.col("prefix_tokens")
    asked = {"none": token_counts.longest_prefix(p, -1), "empty": token_counts.longest_prefix(p, 0), "below": token_counts.tokens_before(p, F.lit(-1)), "beyond": token_counts.tokens_before(p, F.lit(99)), "start": token_counts.tokens_before(p, F.lit(0))}
    rows = {r.doc_id: r for r in counted.select("doc_id", *[c.alias(n) for n, c in asked.items()]).collect()}
    assert [tuple(rows[i])[1:] for i in (1, 2, 3)] == [(None, 0, None, None, 0), (None, 0, None, None, 0), (None,) * 5]
