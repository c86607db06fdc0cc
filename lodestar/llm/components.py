"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.shared import Work


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b) -> edges: each node's larger (large) or smaller (small) neighbours are hung on the least one it has or is."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    m = F.least("u", F.min("v").over(Window.partitionBy("u")))
    near = both.withColumn("m", m)
    out = near.where("v > u" if large else "v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(near.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the pairs that isn't the least of its component; root is the least one.

    The number of rounds grows with the logarithm of the longest path; each ends in a table that is written."""
    work = Work(pairs.sparkSession, "components")
    edges = work.keep("0", pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    before, i = None, 0
    while True:
        edges, i = work.keep(f"{i + 1}", _step(_step(edges, True), False)), i + 1
        work.drop(f"{i - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
