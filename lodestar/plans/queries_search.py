"""Queries of retrieval, re-ranking, gap filling and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.config import Config
from lodestar.functions.text import locator
from lodestar.operators import context, gaps, rerank, retrieval
from lodestar.plans import inputs
from lodestar.plans.inputs import CHUNKS_SQL, FILES_SQL, NL, table
from lodestar.plans.registry import query

_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _bm25_sql(docs: str = "documents", name: str = "bm") -> str:
    return f"""{name}_t AS (SELECT doc_id, {_TOKENS} AS t FROM {docs} WHERE text IS NOT NULL),
{name}_s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {name}_t),
{name}_p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM {name}_t) GROUP BY ALL),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
{name}_g AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM {name}_p JOIN {name}_d USING (term) JOIN {name}_q USING (term), {name}_s GROUP BY query_id, doc_id),
{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM {name}_g) WHERE rank <= 42)"""


def _vec_sql(store: str = "embeddings", name: str = "ve", only: str = "q.vec_id IN (SELECT item_id FROM benchmark)") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM
  (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) + 0.0 AS score FROM embeddings q, {store} d WHERE {only})) WHERE rank <= 42)"""


def _fuse_sql(*legs: str) -> str:
    return f"""un AS ({" UNION ALL ".join(f"SELECT query_id, doc_id, rank FROM {leg}" for leg in legs)}),
fu AS (SELECT query_id, doc_id, CAST(sum(CAST(1.0::DOUBLE / (60 + rank) AS DECIMAL(20, 12))) AS DOUBLE) AS hybrid_score FROM un GROUP BY query_id, doc_id),
hy AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, doc_id) AS INTEGER) AS rank FROM fu) WHERE rank <= 42)"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def _query_vectors(spark, sf_dir):
    """A query's vector is the one that has its number."""
    return _vectors(spark, sf_dir).withColumnRenamed("doc_id", "query_id").join(inputs.queries(spark, sf_dir).select("query_id"), "query_id", "left_semi")


@query("bm25_topk", f"WITH {_bm25_sql()} SELECT query_id, doc_id, score, rank FROM bm")
def bm25_topk(spark, sf_dir):
    return retrieval.bm25(table(spark, sf_dir, "documents"), inputs.queries(spark, sf_dir))


@query("bm25_postings", f"SELECT doc_id, CAST(dl AS INTEGER) AS dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)) GROUP BY ALL")
def bm25_postings(spark, sf_dir):
    return retrieval.postings(table(spark, sf_dir, "documents"))


@query("vector_topk", f"WITH {_vec_sql(only='true')} SELECT query_id, doc_id, score, rank FROM ve")
def vector_topk(spark, sf_dir):
    store = _vectors(spark, sf_dir)
    return retrieval.nearest(store, store.withColumnRenamed("doc_id", "query_id")).withColumn("score", F.col("score") + 0.0)


def _hybrid(spark, sf_dir, docs=None, store=None):
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    store = _vectors(spark, sf_dir) if store is None else store
    return retrieval.hybrid(docs, store, inputs.queries(spark, sf_dir), _query_vectors(spark, sf_dir))


@query("hybrid_rrf", f"WITH {_bm25_sql()}, {_vec_sql()}, {_fuse_sql('bm', 've')} SELECT query_id, doc_id, hybrid_score, rank FROM hy")
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir)


_ENABLED = "(SELECT documents.* FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 1) = 1)"
_ENABLED_V = "(SELECT embeddings.* FROM embeddings LEFT JOIN labels ON doc_id = vec_id WHERE coalesce(quality, 1) = 1 AND vec_id IN (SELECT doc_id FROM documents))"


@query("hybrid_rrf_enabled", f"WITH {_bm25_sql(_ENABLED)}, {_vec_sql(_ENABLED_V)}, {_fuse_sql('bm', 've')} SELECT query_id, doc_id, hybrid_score, rank FROM hy")
def hybrid_rrf_enabled(spark, sf_dir):
    catalog = inputs.files(spark, sf_dir).withColumn("file_md5", F.col("file_md5").cast("long"))
    return _hybrid(spark, sf_dir, retrieval.allowed(table(spark, sf_dir, "documents"), catalog), retrieval.allowed(_vectors(spark, sf_dir), catalog))


_RERANK = f"""qt AS (SELECT item_id AS query_id, list_distinct({_TOKENS}) AS q FROM benchmark), dt AS (SELECT doc_id, {_TOKENS} AS d FROM documents),
sc AS (SELECT bm.*, CASE WHEN len(q) = 0 THEN 0.0 ELSE round(len(list_intersect(q, d))::DOUBLE / len(q), 6) END AS ce FROM bm JOIN qt USING (query_id) JOIN dt USING (doc_id)),
rr AS (SELECT * FROM (SELECT query_id, doc_id, ce, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ce DESC, rank) AS INTEGER) AS ce_rank FROM sc) WHERE ce_rank <= 15)"""


def _reranked(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), inputs.queries(spark, sf_dir)
    found = retrieval.bm25(docs, asked)
    return rerank.rerank(rerank.overlap_scores(found, docs, asked))


@query("rerank_topk", f"WITH {_bm25_sql()}, {_RERANK} SELECT query_id, doc_id, ce AS cross_encoder_score, ce_rank FROM rr")
def rerank_topk(spark, sf_dir):
    return _reranked(spark, sf_dir).select("query_id", "doc_id", "cross_encoder_score", "ce_rank")


#: A model's scores: some are missing, and some come twice with the last one counting.
_SCORES = """s0 AS (SELECT query_id, doc_id, (doc_id * 7 + query_id * 3) % 11 AS score, 'first' AS reason, 0 AS ord FROM rr WHERE (doc_id + query_id) % 13 <> 0
  UNION ALL SELECT query_id, doc_id, (doc_id * 5 + query_id) % 11, 'again', 1 FROM rr WHERE (doc_id + query_id) % 4 = 1),
al AS (SELECT rr.*, CAST(coalesce(arg_max(score, ord), -1) AS INTEGER) AS llm_score, coalesce(arg_max(reason, ord), 'LLM 未返回评分') AS llm_reason FROM rr LEFT JOIN s0 USING (query_id, doc_id) GROUP BY ALL)"""
_TIERS = """tc AS (SELECT query_id, count(*) AS n, count_if(llm_score >= 8) AS at_least_8, count_if(llm_score >= 7) AS at_least_7, count_if(llm_score >= 6) AS at_least_6, count_if(llm_score >= 5) AS at_least_5, max(llm_score) AS top_score FROM al GROUP BY query_id),
ti AS (SELECT query_id, n, top_score, CASE WHEN at_least_8 * 2 > n THEN 8 WHEN at_least_7 * 2 > n THEN 7 WHEN at_least_6 * 2 > n THEN 6 ELSE 5 END AS tier FROM tc)"""


def _aligned(spark, sf_dir):
    rows = _reranked(spark, sf_dir)
    key = F.col("doc_id") + F.col("query_id")
    pair = rows.select("query_id", "doc_id")
    first = pair.where(key % 13 != 0).select("query_id", "doc_id", ((F.col("doc_id") * 7 + F.col("query_id") * 3) % 11).cast("int").alias("score"), F.lit("first").alias("reason"), F.lit(0).alias("ord"))
    again = pair.where(key % 4 == 1).select("query_id", "doc_id", ((F.col("doc_id") * 5 + F.col("query_id")) % 11).cast("int").alias("score"), F.lit("again").alias("reason"), F.lit(1).alias("ord"))
    return rerank.align(rows, first.unionByName(again))


@query("score_align", f"WITH {_bm25_sql()}, {_RERANK}, {_SCORES} SELECT query_id, doc_id, llm_score, llm_reason FROM al")
def score_align(spark, sf_dir):
    return _aligned(spark, sf_dir).select("query_id", "doc_id", "llm_score", "llm_reason")


@query("tier_counts", f"WITH {_bm25_sql()}, {_RERANK}, {_SCORES}, {_TIERS} SELECT * FROM tc")
def tier_counts(spark, sf_dir):
    return rerank.tier_counts(_aligned(spark, sf_dir))


@query("tier_sieve", f"WITH {_bm25_sql()}, {_RERANK}, {_SCORES}, {_TIERS} SELECT query_id, doc_id, llm_score, tier FROM al JOIN ti USING (query_id) WHERE llm_score >= tier")
def tier_sieve(spark, sf_dir):
    return rerank.sieve(_aligned(spark, sf_dir)).select("query_id", "doc_id", "llm_score", "tier")


@query("low_confidence", f"WITH {_bm25_sql()}, {_RERANK}, {_SCORES.replace('% 11', '% 6')}, {_TIERS} SELECT query_id, doc_id, ce_rank FROM al WHERE ce_rank <= 5 AND query_id NOT IN (SELECT query_id FROM al JOIN ti USING (query_id) WHERE llm_score >= tier)")
def low_confidence(spark, sf_dir):
    rows = _reranked(spark, sf_dir)
    key = F.col("doc_id") + F.col("query_id")
    pair = rows.select("query_id", "doc_id")
    first = pair.where(key % 13 != 0).select("query_id", "doc_id", ((F.col("doc_id") * 7 + F.col("query_id") * 3) % 6).cast("int").alias("score"), F.lit("").alias("reason"), F.lit(0).alias("ord"))
    again = pair.where(key % 4 == 1).select("query_id", "doc_id", ((F.col("doc_id") * 5 + F.col("query_id")) % 6).cast("int").alias("score"), F.lit("").alias("reason"), F.lit(1).alias("ord"))
    return rerank.low_confidence(rerank.align(rows, first.unionByName(again))).select("query_id", "doc_id", "ce_rank")


_HELD = "tions"


def _candidates(spark, sf_dir):
    """Each document asks for itself, and finds those of its chunks that hold a word's end."""
    store = inputs.chunks(spark, sf_dir)
    return store.where(F.contains("text", F.lit(_HELD))).select(F.col("doc_id").alias("query_id"), "doc_id", "chunk_index"), store


_CAND = f"ca AS (SELECT doc_id AS query_id, doc_id, chunk_index FROM chunks WHERE contains(text, '{_HELD}'))"
_GAPS = """gp AS (SELECT query_id, doc_id, chunk_index, lead(chunk_index) OVER (PARTITION BY query_id, doc_id ORDER BY chunk_index) AS nx FROM ca),
gk AS (SELECT query_id, doc_id, unnest(range(chunk_index + 1, nx)) AS chunk_index FROM gp WHERE nx - chunk_index - 1 BETWEEN 1 AND 2),
gf AS (SELECT gk.query_id, gk.doc_id, CAST(gk.chunk_index AS INTEGER) AS chunk_index FROM gk SEMI JOIN chunks USING (doc_id, chunk_index))"""


@query("gap_fill", f"WITH RECURSIVE {CHUNKS_SQL}, {_CAND}, {_GAPS} SELECT * FROM gf")
def gap_fill(spark, sf_dir):
    candidates, store = _candidates(spark, sf_dir)
    return gaps.fill_gaps(candidates, store, 2)


@query("neighbor_expand", f"""WITH RECURSIVE {CHUNKS_SQL}, {_CAND}, {_GAPS}, bo AS (SELECT * FROM ca UNION ALL SELECT * FROM gf),
nb AS (SELECT DISTINCT query_id, doc_id, chunk_index + o AS chunk_index FROM bo, (VALUES (-1), (1)) v(o))
SELECT *, 'candidate' AS origin FROM ca UNION ALL SELECT *, 'gap' FROM gf
UNION ALL SELECT query_id, doc_id, chunk_index, 'neighbour' FROM (SELECT * FROM nb ANTI JOIN bo USING (query_id, doc_id, chunk_index)) SEMI JOIN chunks USING (doc_id, chunk_index)""")
def neighbor_expand(spark, sf_dir):
    candidates, store = _candidates(spark, sf_dir)
    return gaps.expand(candidates, store, 2, 1)


@query("gap_fill_budgeted")
def gap_fill_budgeted(spark, sf_dir):
    candidates, store = _candidates(spark, sf_dir)
    return gaps.fill(candidates, store, Config(gap_tokens=1200))


@query("locator", f"""WITH RECURSIVE {CHUNKS_SQL}
SELECT doc_id, chunk_index, CASE WHEN doc_id % 2 = 0 THEN '页码 [' || (chunk_index + 1) || ', ' || (chunk_index + 2) || '] — ' ELSE '' END || CASE WHEN chunk_index % 3 = 0 THEN 'Chapter ' || chunk_index || ' — ' ELSE '' END || 'chunk #' || chunk_index AS locator FROM chunks""")
def source_locator(spark, sf_dir):
    i = F.col("chunk_index")
    pages = F.when(F.col("doc_id") % 2 == 0, F.array(i + 1, i + 2)).otherwise(F.array().cast("array<int>"))
    chapter = F.when(i % 3 == 0, F.concat(F.lit("Chapter "), i.cast("string"))).otherwise(F.lit(""))
    return inputs.chunks(spark, sf_dir).select("doc_id", "chunk_index", locator(pages, chapter, i).alias("locator"))


@query("context_trim")
def context_trim(spark, sf_dir):
    rows = inputs.chunks(spark, sf_dir)
    chunks = rows.select(F.col("doc_id").alias("query_id"), "doc_id", F.lit("").alias("doc_name"), F.array(F.lit(1)).alias("page_nums"), F.lit("").alias("chapter_title"), "chunk_index", "text")
    return context.contexts(chunks, limit=3000)


@query("context_parts", f"""WITH RECURSIVE {CHUNKS_SQL}
SELECT doc_id AS query_id, string_agg('--- 文档片段 ' || (chunk_index + 1) || ' (来源: ' || doc_id || ', 页码 [1], chunk #' || chunk_index || ') ---' || {NL} || text, {NL} || {NL} ORDER BY chunk_index) AS context FROM chunks GROUP BY doc_id""")
def context_parts(spark, sf_dir):
    rows = inputs.chunks(spark, sf_dir)
    chunks = rows.select(F.col("doc_id").alias("query_id"), "doc_id", F.lit("").alias("doc_name"), F.array(F.lit(1)).alias("page_nums"), F.lit("").alias("chapter_title"), "chunk_index", "text")
    return context.contexts(chunks, limit=1 << 30)


@query("history_context", f"""WITH t AS (SELECT conv_id, turn, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM t WHERE back <= 5)
SELECT CAST(conv_id AS VARCHAR) AS session_id, '[历史对话]' || {NL} || string_agg('历史问答 ' || i || ':' || {NL} || '  问题: ' || text || {NL} || '  回答: ' || role || {NL} || '  参考文档: ' || CASE WHEN turn % 3 = 0 THEN '无' ELSE role || ' (页码 [' || turn || '], chunk #' || turn || ')' END, {NL} ORDER BY turn) || {NL} || '---' AS history FROM k GROUP BY conv_id""")
def history_context(spark, sf_dir):
    from lodestar.operators.history import restore

    return restore(inputs.turns(spark, sf_dir)).select("session_id", context.history(F.col("messages")).alias("history"))
