"""Retrieval: BM25 over documents or a kept index, exact vector search, reciprocal-rank fusion and the hybrid search made of them.

All take many queries at once; every stage is grouped by query_id, so a thousand queries are one job."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lodestar.config import Config
from lodestar.functions.arrow import pieces

TOKEN_BREAK = r"[^\p{L}\p{N}]+"
#: Pairs of a query and a term that go to the tasks at once, some 10 MB; more are asked in several passes.
BLOCK = 200_000
#: Documents whose terms are looked up at once in a task, their bytes on average, and scores of documents and queries that are held at once.
LOOKED, LOOKED_BYTES, CELLS = 1024, 8 << 20, 1 << 20
#: Partitions of the kept full-text index, by a hash of the term.
BUCKETS = 64


def tokens(text: Column, bigrams: bool = False) -> Column:
    """Runs of letters and digits in lower case; with `bigrams`, runs of Han characters also as overlapping pairs."""
    words = F.filter(F.split(F.lower(text), TOKEN_BREAK, -1), lambda x: x != "")
    if not bigrams:
        return words
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))
    return F.flatten(F.transform(words, lambda w: F.when(w.rlike(r"^\p{IsHan}{2,}$"), pairs(w)).otherwise(F.array(w))))


def postings(docs: DataFrame, bigrams: bool = False) -> DataFrame:
    """documents(doc_id, text) -> doc_id, dl, term, tf: the full-text index; written, it is partitioned by a hash of the term."""
    split = docs.select("doc_id", tokens(F.col("text"), bigrams).alias("t")).select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return split.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def top(df: DataFrame, k: int, score: str, *ties: str, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """The k best rows of each query, numbered from 1; ties by the given columns."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), *ties)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


class _Best:
    """The k best rows of each query so far: by score, falling, then by doc_id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least = k, np.full(n, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray] | None] = [None] * n

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.held[q] is not None:
            scores, ids = np.append(self.held[q][0], scores), np.append(self.held[q][1], ids)
        if len(scores) > self.k:
            order = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[order], ids[order]
            self.least[q] = scores[-1]
        self.held[q] = scores, ids

    def rows(self, queries: pa.Array, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        some = [q for q, held in enumerate(self.held) if held is not None and len(held[0])]
        for i in range(0, len(some), 1024):
            part = some[i : i + 1024]
            at = np.repeat(part, [len(self.held[q][0]) for q in part])
            ids, scores = (np.concatenate([self.held[q][x] for q in part]) for x in (1, 0))
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(at)), pa.array(ids, kind), pa.array(scores)], names=["query_id", "doc_id", "score"])


class _Asked:
    """The terms of a block of queries, and which queries ask for each."""

    def __init__(self, rows: pa.Table) -> None:
        names = rows["query_id"].combine_chunks().dictionary_encode()
        terms = rows["term"].combine_chunks().dictionary_encode()
        self.queries, self.terms = names.dictionary, terms.dictionary
        term, query = terms.indices.to_numpy(), names.indices.to_numpy()
        order = np.lexsort((query, term))
        self.of = query[order].astype(np.int64)
        self.begin = np.searchsorted(term[order], np.arange(len(self.terms) + 1))

    def postings(self, t: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, tf) of the terms that are asked for, by row."""
        at = pc.index_in(t.flatten(), value_set=self.terms).fill_null(-1).to_numpy().astype(np.int64)
        rows = np.repeat(np.arange(len(t)), np.diff(t.offsets.to_numpy()))
        key, tf = np.unique((rows * len(self.terms) + at)[at >= 0], return_counts=True)
        return key // len(self.terms), key % len(self.terms), tf

    def counted(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, dl, t) -> (term, n): documents that hold each term; at -1 all of them, at -2 their words."""
        df, n, words = np.zeros(len(self.terms), np.int64), 0, 0
        for batch in (piece for whole in batches for piece in pieces(whole, LOOKED, LOOKED_BYTES)):
            df += np.bincount(self.postings(batch.column(2))[1], minlength=len(df))
            n, words = n + batch.num_rows, words + (pc.sum(batch.column(1)).as_py() or 0)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [-1, -2])), pa.array(np.append(df[held], [n, words]))], names=["term", "n"])

    def scored(self, batches: Iterator[pa.RecordBatch], idf: np.ndarray, mean: float, k: int, config: Config, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """(doc_id, dl, t) -> the k best documents of each query in this partition: (query_id, doc_id, score)."""
        n, best, asked = len(self.queries), _Best(len(self.queries), k), np.diff(self.begin)
        for batch in (piece for whole in batches for piece in pieces(whole, LOOKED, LOOKED_BYTES)):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            row, term, tf = self.postings(batch.column(2))
            dl = batch.column(1).to_numpy()[row]
            gain = idf[term] * tf * (config.bm25_k1 + 1) / (tf + config.bm25_k1 * (1 - config.bm25_b + config.bm25_b * dl / mean))
            step = max(1, min(1024, CELLS // n))  # documents whose scores for all queries are held at once
            for low in range(0, len(ids), step):
                lo, hi = np.searchsorted(row, (low, low + step))
                size = asked[term[lo:hi]]
                if not size.sum():
                    continue
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.begin[term[lo:hi]], size)
                cell = self.of[at] * step + np.repeat(row[lo:hi] - low, size)
                total = np.bincount(cell, np.repeat(gain[lo:hi], size), n * step).reshape(n, step)
                rounded = np.round(total, 6)
                good = (total > 0) & (rounded >= best.least[:, None])
                for q in np.flatnonzero(good.any(axis=1)).tolist():
                    x = np.flatnonzero(good[q])
                    best.add(q, rounded[q, x], ids[low + x])
        yield from best.rows(self.queries, kind)


def _in_blocks(queries: DataFrame, size: int) -> Iterator[pa.Table]:
    """Rows of queries at the driver, all rows of a query in one block; blocks have some `size` rows, and are asked one after the other."""
    n = max(1, -(-queries.count() // size))
    for i in range(n):
        found = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).toArrow()
        if found.num_rows:
            yield found


def _together(found: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = None, config: Config = Config()) -> DataFrame:
    """documents(doc_id, text) and queries(query_id, text) -> query_id, doc_id, score (6 decimals), rank.

    The terms of the queries, BLOCK at a time, go to the documents: one pass counts documents, words and the documents of
    each term, and the next one scores every document where it stands. Each task keeps the k best of a query, and these
    rows are all that is shuffled. Every row with a doc_id and a text is a document; one without a query term has no row."""
    k = k or config.hybrid_top_k
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    split = docs.where("doc_id is not null and text is not null").select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("dl"), "t")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    found = []
    for rows in _in_blocks(asked, BLOCK):
        block = _Asked(rows)
        counts = {r.term: r.n for r in split.mapInArrow(block.counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the block
        n = counts.get(-1, 0)
        df = [counts.get(i, 0) for i in range(len(block.terms))]
        idf = np.array([log(1 + (n - d + 0.5) / (d + 0.5)) for d in df])
        mean = counts.get(-2, 0) / n if n else 1.0
        found.append(split.mapInArrow(lambda it, b=block, i=idf, m=mean: b.scored(it, i, m, k, config, kind), schema))
    return top(_together(found, docs.sparkSession, schema), k, "score", "doc_id")


def kept_postings(chunks: DataFrame) -> DataFrame:
    """Chunks(id, doc_id, text) as rows of the kept full-text index, which is partitioned by `bucket`, a hash of the term."""
    rows = postings(chunks.where("text is not null").select(F.struct("id", "doc_id").alias("doc_id"), "text"))
    return rows.select(_bucket("term").alias("bucket"), "term", F.col("doc_id.id").alias("id"), F.col("doc_id.doc_id").alias("doc_id"), "dl", "tf")


def kept_lengths(chunks: DataFrame) -> DataFrame:
    """Of each file the number of its chunks and of their words: what a search needs to know of documents without its terms."""
    return chunks.where("text is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.size(tokens(F.col("text")))).cast("long").alias("words"))


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def bm25_kept(index: DataFrame, lengths: DataFrame, queries: DataFrame, enabled: DataFrame | None = None, k: int | None = None, config: Config = Config()) -> DataFrame:
    """bm25() from a kept index (kept_postings(), kept_lengths()): query_id, id, score, rank.

    Only the buckets and terms that are asked for are read, so a search costs what its terms' postings cost, not a scan of
    the texts. enabled(doc_id): the files that count; all if there is none. For BLOCK terms of queries at most."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).withColumn("bucket", _bucket("term"))
    rows = asked.limit(BLOCK + 1).collect()
    if len(rows) > BLOCK:
        raise ValueError(f"over {BLOCK} terms: ask in blocks")
    hits = index.where(F.col("bucket").isin(sorted({r.bucket for r in rows})) & F.col("term").isin(sorted({r.term for r in rows})))
    if enabled is not None:
        hits, lengths = hits.join(enabled, "doc_id", "left_semi"), lengths.join(enabled, "doc_id", "left_semi")
    n, words = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.broadcast(df.select("term", F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")))  # a row for each term that is asked for
    gain = F.col("idf") * F.col("tf") * (config.bm25_k1 + 1) / (F.col("tf") + config.bm25_k1 * (1 - config.bm25_b + config.bm25_b * F.col("dl") / F.lit(words / n if n else 1.0)))
    scored = hits.join(idf, "term").select("term", "id", gain.alias("gain")).join(F.broadcast(asked.select("query_id", "term")), "term")
    return top(scored.groupBy("query_id", "id").agg(F.round(F.sum("gain"), 6).alias("score")), k or config.hybrid_top_k, "score", "id")


def nearest(store: DataFrame, queries: DataFrame, k: int | None = None, config: Config = Config(), block: int = 4096) -> DataFrame:
    """store(doc_id, vector) and queries(query_id, vector) -> query_id, doc_id, score (dot product, 6 decimals), rank; exact.

    Blocks of queries go to the store's partitions: each batch of vectors is one matrix product in single precision, and what a bound on
    its error lets into the k best is multiplied anew in double. A task keeps the k best of each query, and these rows are all that is
    shuffled; if there are many blocks, each is asked in few tasks, so that these rows don't grow with blocks times partitions. Vectors of the
    store don't move. Rows without a vector or an id don't count."""
    k = k or config.hybrid_top_k
    kind = to_arrow_type(store.schema["doc_id"].dataType)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {store.schema['doc_id'].dataType.simpleString()}, score double"
    rows = store.where("doc_id is not null and vector is not null").select("doc_id", "vector")

    def best(batches: Iterator[pa.RecordBatch], names: pa.Array, asked: pa.Array) -> Iterator[pa.RecordBatch]:
        found = _Nearest(_matrix(asked), k)
        for batch in batches:
            ids, all_ = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
            for low in range(0, len(ids), 1024):
                found.add(all_[low : low + 1024], ids[low : low + 1024])
        yield from found.rows(names, kind)

    parts = [part.take(pa.array(np.arange(at, min(at + block, part.num_rows)))) for part in _in_blocks(queries.where("query_id is not null and vector is not null").select("query_id", "vector"), 16 * block) for at in range(0, part.num_rows, block)]
    if len(parts) > 1:
        rows = rows.coalesce(max(1, -(-4 * store.sparkSession.sparkContext.defaultParallelism // len(parts))))
    found = [rows.mapInArrow(lambda it, n=part["query_id"].combine_chunks(), a=part["vector"].combine_chunks(): best(it, n, a), schema) for part in parts]
    return top(_together(found, store.sparkSession, schema), k, "score", "doc_id")


class _Nearest:
    """The k nearest rows of each query so far, by score, falling, then by doc_id."""

    def __init__(self, asked: np.ndarray, k: int) -> None:
        self.k, self.asked = k, asked
        self.narrow, self.norm = asked.astype(np.float32), np.sqrt((asked * asked).sum(axis=1))
        self.least = np.full(len(asked), -np.inf)
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), None
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, all_: np.ndarray, ids: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            rough = self.narrow @ all_.astype(np.float32).T
            # what single precision can be off by, and rounding
            off = (all_.shape[1] + 8) * 2.0**-23 * self.norm * np.sqrt((all_ * all_).sum(axis=1)).max() + 1e-6
            least = self.least
            if len(ids) > self.k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(rough, -self.k, axis=1)[:, -self.k] - off)
            bound = np.nextafter((least - off).astype(np.float32), np.float32(-np.inf))
            q, x = np.nonzero(~(rough < bound[:, None]))
            for at in range(0, len(q), 1 << 16):
                i, j = q[at : at + (1 << 16)], x[at : at + (1 << 16)]
                score = np.round(np.einsum("ij,ij->i", self.asked[i], all_[j]), 6)
                good = score >= self.least[i]
                self.new.append((i[good], score[good], ids[j[good]]))
                self.held += int(good.sum())
        if self.held >= self.k * len(self.asked) // 2 or np.isneginf(self.least).any():
            self._merge()

    def _merge(self) -> None:
        if not self.new:
            return
        query, score, ids = map(np.concatenate, zip(*self.new, *([(self.query, self.score, self.id)] if self.id is not None else [])))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        self.query, self.score, self.id = (v[nth < self.k] for v in (query, score, ids))
        last = nth == self.k - 1
        self.least[query[last]] = score[last]
        self.new, self.held = [], 0

    def rows(self, queries: pa.Array, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        self._merge()
        for at in range(0, len(self.query), 1 << 16):
            some = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(self.query[some])), pa.array(self.id[some], kind), pa.array(self.score[some])], names=["query_id", "doc_id", "score"])


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def near_bucketed(store: DataFrame, queries: DataFrame, k: int, tables: int = 8, length: float = 2.0) -> DataFrame:
    """The same, approximately, through Spark's LSH of random projections; for stores where exact search is too slow."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", numHashTables=tables, bucketLength=length, seed=7)
    d, q = (df.select(key, array_to_vector("vector").alias("v")) for df, key in ((store, "doc_id"), (queries, "query_id")))
    near = lsh.fit(d).approxSimilarityJoin(q, d, 2.0, "dist").select(F.col("datasetA.query_id").alias("query_id"), F.col("datasetB.doc_id").alias("doc_id"), F.round(1 - F.col("dist") * F.col("dist") / 2, 6).alias("score"))
    return top(near, k, "score", "doc_id")


def fuse(*legs: DataFrame, k: int | None = None, config: Config = Config()) -> DataFrame:
    """Reciprocal-rank fusion of legs(query_id, doc_id, rank) -> query_id, doc_id, hybrid_score, rank: a union and a sum, no outer join."""
    every = legs[0].select("query_id", "doc_id", "rank")
    for leg in legs[1:]:
        every = every.unionByName(leg.select("query_id", "doc_id", "rank"))
    # a decimal sum is the same in whatever order the ranks come
    part = (F.lit(1.0) / (config.rrf_k + F.col("rank"))).cast("decimal(20,12)")
    total = every.groupBy("query_id", "doc_id").agg(F.sum(part).cast("double").alias("hybrid_score"))
    return top(total, k or config.hybrid_top_k, "hybrid_score", "doc_id")


def allowed(store: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Tri-state filter: without any catalog rows nothing is left out; else only documents that are enabled stay, which may be none."""
    if catalog is None or not catalog.limit(1).count():
        return store
    return store.join(catalog.where("is_enabled").select(F.col("file_md5").alias("doc_id")).distinct(), "doc_id", "left_semi")


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, config: Config = Config()) -> DataFrame:
    """Both legs to the same depth, fused: query_id, doc_id, hybrid_score, rank."""
    return fuse(bm25(docs, queries, config=config), nearest(vectors, query_vectors, config=config), config=config)
