"""Re-ranking: the pair score's best, the model's scores set against the candidates, and the sieve by tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.config import Config
from lodestar.operators.retrieval import tokens, top

MISSING = "LLM 未返回评分"


def overlap_scores(candidates: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """The stand-in for a cross-encoder: share of the query's terms that the document holds; candidates get cross_encoder_score."""
    # texts meet the candidates before they are split, so that only those of candidates are
    q = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("_q"))
    joined = candidates.join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id").join(q, "query_id")
    joined = joined.withColumn("_d", tokens(F.col("_text"))).drop("_text")
    share = F.size(F.array_intersect("_q", "_d")) / F.nullif(F.size("_q"), F.lit(0))
    return joined.withColumn("cross_encoder_score", F.round(F.coalesce(share, F.lit(0.0)), 6)).drop("_q", "_d")


def rerank(scored: DataFrame, k: int | None = None, config: Config = Config()) -> DataFrame:
    """The k best by cross_encoder_score (null as 0), in the order they had among equals."""
    filled = scored.withColumn("_s", F.coalesce("cross_encoder_score", F.lit(0.0)))
    return top(filled, k or config.rerank_top_k, "_s", "rank", rank="ce_rank").drop("_s")


def align(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """candidates(query_id, doc_id, ...) with scores(query_id, doc_id, score, reason, ord): of several rows the last counts; none gives -1 and a note."""
    last = Window.partitionBy("query_id", "doc_id").orderBy(F.col("ord").desc())
    final = scores.withColumn("_k", F.row_number().over(last)).where("_k = 1").select("query_id", "doc_id", F.col("score").alias("_score"), F.col("reason").alias("_reason"))
    out = candidates.join(final, ["query_id", "doc_id"], "left")
    return out.withColumn("llm_score", F.coalesce("_score", F.lit(-1)).cast("int")).withColumn("llm_reason", F.when(F.col("_score").isNull(), F.lit(MISSING)).otherwise(F.col("_reason"))).drop("_score", "_reason")


def tier_counts(aligned: DataFrame, config: Config = Config()) -> DataFrame:
    """query_id, n, at_least_<tier>..., top_score: all tiers in one pass."""
    each = [F.count_if(F.col("llm_score") >= t).alias(f"at_least_{t}") for t in config.score_tiers]
    return aligned.groupBy("query_id").agg(F.count("*").alias("n"), *each, F.max(F.coalesce("llm_score", F.lit(0))).alias("top_score"))


def chosen_tier(counts: DataFrame, config: Config = Config()) -> DataFrame:
    """The first tier that over half of a query's candidates reach (those without a score count as candidates); else the last."""
    tier = F.lit(config.score_tiers[-1])
    for t in reversed(config.score_tiers[:-1]):
        tier = F.when(F.col(f"at_least_{t}") * 2 > F.col("n"), F.lit(t)).otherwise(tier)
    return counts.select("query_id", "n", "top_score", tier.alias("tier"))


def sieve(aligned: DataFrame, config: Config = Config()) -> DataFrame:
    """Candidates that reach their query's tier; a query may have none."""
    tiers = chosen_tier(tier_counts(aligned, config), config).select("query_id", "tier")
    return aligned.join(tiers, "query_id").where(F.col("llm_score") >= F.col("tier"))


def low_confidence(aligned: DataFrame, config: Config = Config()) -> DataFrame:
    """The first few candidates by pair score of queries whose sieve kept none."""
    passed = sieve(aligned, config).select("query_id").distinct()
    return aligned.join(passed, "query_id", "left_anti").where(F.col("ce_rank") <= config.low_confidence_keep)
