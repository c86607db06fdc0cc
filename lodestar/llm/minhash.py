"""MinHash near-dedup with BagMinHash signatures of word-pair multisets, banding, and exact weighted Jaccard of what the bands bring together.

Each element x of weight w stands for the interval [0, w) of levels. Levels are cut into the blocks [0, 1), [1, 2),
[2, 4), [4, 8), ...; every block of every element has its own Poisson process, whose points carry a slot and a level
drawn from their hash. A slot's minimum is the first point, over all elements, whose level lies under the element's weight;
two bags agree on a slot with a probability of sum(min) / sum(max). Points come in order of time, so a process ends as soon as
it is later than all minima, and a bag of n elements takes about n + m log m points for m slots, whatever its weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.components import components
from lodestar.llm.hashing import PLAIN, U, gram_rows, grams, mix, slices, words
from lodestar.llm.shared import Work, fresh, with_ids

#: Pairs at the threshold share a bucket with a probability of 1 - (1 - 0.5 ** 4) ** 48 = 0.95, nearer ones with more.
BANDS, ROWS = 48, 4
#: Words to an element, and the least sum(min) / sum(max) of near copies.
GRAM = 2
THRESHOLD = 0.5
#: What isn't near its bucket's first document is compared with the whole bucket, if that has FEW members at most; in
#: larger ones with the first of what is left, and so on, so many times at most while it finds any. That is only to have less
#: left over: what such a bucket then has of more groups than one is compared each with each, in blocks of so many rows and bytes.
FEW, STAR_ROUNDS = 64, 6
BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20


def bags(data: np.ndarray, off: np.ndarray, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, weight), sorted by row and element. The only element of a row of under k words is all its words."""
    h, _, _, first = words(data, off, PLAIN)
    at, rows = gram_rows(first, k)
    values = grams(h, k)[at] if len(at) else np.zeros(0, U)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        value = np.zeros(len(short), U)
        for j in range(k - 1):
            more = count[short] > j
            value[more] = mix(value[more] + h[first[short[more]] + j])
        rows, values = np.concatenate([rows, short]), np.concatenate([values, value])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    begin = np.flatnonzero(new)
    return rows[begin], values[begin], np.diff(np.append(begin, len(rows)))


def signatures(rows: np.ndarray, x: np.ndarray, w: np.ndarray, n: int, m: int) -> np.ndarray:
    """n signatures of m slots; a row without elements has zeros."""
    least, point = np.full(n * m, np.inf), np.zeros(n * m, U)
    seeds, owner, width, inside = [], [], [], []
    low, block = 0, 1
    left = np.arange(len(x))
    while len(left):
        seeds.append(mix(x[left] + U(block * 0xD6E8FEB86659FD93 % (1 << 64))))
        owner.append(rows[left])
        width.append(np.full(len(left), block - low, np.int64))
        inside.append(np.minimum(w[left], block) - low)
        left = left[w[left] > block]
        low, block = block, 2 * block
    if not seeds:
        return point.reshape(n, m)
    seed, row, size, limit = map(np.concatenate, (seeds, owner, width, inside))
    t, done = np.zeros(len(seed)), 0
    latest = np.full(n, np.inf)
    while len(seed):
        burst = int(min(64, max(1, 16384 // len(seed))))
        u = mix(seed[:, None] + np.arange(done + 1, done + burst + 1, dtype=U)[None, :] * U(0x9E3779B97F4A7C15))
        gap = -np.log(((u >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / size[:, None]
        gap[:, 0] += t
        times = np.cumsum(gap, axis=1)
        v = mix(u ^ U(0xA5A5A5A5A5A5A5A5))
        cell = row[:, None] * m + (v & U(0xFFFFFFFF)).astype(np.int64) % m
        ok = ((v >> U(32)).astype(np.int64) % size[:, None] < limit[:, None]) & (times <= least[cell])
        cells, when, names = cell[ok], times[ok], v[ok]
        np.minimum.at(least, cells, when)
        won = when == least[cells]
        point[cells[won]] = names[won]
        done += burst
        t = times[:, -1]
        latest = least.reshape(n, m).max(axis=1)
        on = t < latest[row]
        seed, row, size, limit, t = seed[on], row[on], size[on], limit[on], t[on]
    return point.reshape(n, m)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U))[None, :], (len(sig), bands)).copy()
    parts = sig.reshape(len(sig), bands, rows)
    for r in range(rows):
        out = mix(out * U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out


def _bands(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for begin, end, data, off in slices(batch.column(1)):
            r, x, w = bags(data, off)
            some = np.unique(r)
            if not len(some):
                continue
            sig = signatures(np.searchsorted(some, r), x, w, len(some), bands * rows)
            out = band_hashes(sig, bands, rows)
            yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), pa.array(np.repeat(ids[begin:end][some], bands))], names=["band", "doc_id"])


def jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, left, right) -> (a, b, jaccard): sum(min) / sum(max) of the weights of the two texts' elements."""
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        step = 256
        for i in range(0, batch.num_rows, step):
            sides, n = [], min(step, batch.num_rows - i)
            for texts in (left.slice(i, n), right.slice(i, n)):
                parts = []
                for begin, _, data, off in slices(texts):
                    r, x, w = bags(data, off)
                    parts.append((r + begin, x, w))
                sides.append([np.concatenate(p) for p in zip(*parts)])
            (r1, x1, w1), (r2, x2, w2) = sides
            r, x, w = np.concatenate([r1, r2]), np.concatenate([x1, x2]), np.concatenate([w1, w2])
            order = np.lexsort((x, r))
            r, x, w = r[order], x[order], w[order]
            twice = np.flatnonzero((r[1:] == r[:-1]) & (x[1:] == x[:-1]))
            both = np.bincount(r[twice], np.minimum(w[twice], w[twice + 1]), n)
            all_ = np.bincount(r, w, n) - both
            value = np.divide(both, all_, out=np.zeros(n), where=all_ > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(value)], names=["a", "b", "jaccard"])


def _verified(work: Work, name: str, docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold, with jaccard; texts of other documents aren't moved."""
    pairs = work.keep(f"{name}-pairs", pairs.distinct())
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = with_ids(docs, ids, "left_semi", n=2 * pairs.count())
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
    joined = pairs.join(left.hint("shuffle_merge"), "a").join(right.hint("shuffle_merge"), "b").select("a", "b", "left", "right")
    # a doc_id that stands for several rows is as near as its nearest row
    near = joined.mapInArrow(jaccard, "a long, b long, jaccard double").groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))
    found = work.keep(name, near.where(F.col("jaccard") >= threshold))
    work.drop(f"{name}-pairs")
    return found


def _first(rows: DataFrame) -> DataFrame:
    """rows(band, doc_id) with a, the smallest doc_id of the band, and n, how many it has, where there are others; both are
    counted before they are shuffled, and the join is one that Spark splits where a band is hot."""
    firsts = rows.groupBy("band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("a < last").drop("last")
    return rows.join(firsts.hint("merge"), "band").select("band", "doc_id", "a", "n").where("doc_id <> a")


def _joining(table: pa.Table, threshold: float) -> pa.Table:
    """(i, j, block, doc_id, root, text) of the blocks i and j of a bucket -> (a, b, jaccard): near pairs of a row of i and one of j that join different roots.

    Each row of i is held against all of j at once. A pair whose roots are joined by those before it isn't given, so there are fewer pairs than rows."""
    table = table.combine_chunks()
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    ids, block = table["doc_id"].to_numpy(), table["block"].to_numpy()
    group = np.unique(table["root"].to_numpy(), return_inverse=True)[1]
    parts = [(r + begin, x, w) for begin, _, data, off in slices(table["text"]) for r, x, w in [bags(data, off)]]
    rows, x, w = map(np.concatenate, zip(*parts))
    total = np.bincount(rows, w, len(ids))
    _, x, holders = np.unique(x, return_inverse=True, return_counts=True)
    shared = holders[x] > 1  # an element of one row adds to that row's total only
    rows, x, w = rows[shared], x[shared], w[shared]
    first = np.searchsorted(rows, np.arange(len(ids) + 1))
    other = np.flatnonzero(block[rows] == j)
    rows_j, x_j, w_j = rows[other], x[other], w[other]
    weight, out = np.zeros(len(holders), np.int64), []
    for row in np.flatnonzero((block == i) & (total > 0)):
        mine = slice(first[row], first[row + 1])
        weight[x[mine]] = w[mine]
        both = np.bincount(rows_j, np.minimum(weight[x_j], w_j), len(ids))
        weight[x[mine]] = 0
        value = np.where(block == j, both / (total[row] + total - both), 0)
        if i == j:
            value[: row + 1] = 0
        near = np.flatnonzero(value >= threshold)
        while len(near := near[group[near] != group[row]]):
            a, b = sorted((int(ids[row]), int(ids[near[0]])))
            out.append((a, b, float(value[near[0]])))
            group[group == group[near[0]]] = group[row]
    a, b, value = zip(*out) if out else ((), (), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(value, pa.float64())], names=["a", "b", "jaccard"])


def _between_groups(work: Work, texts: DataFrame, rows: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard): near pairs of the buckets rows(band, doc_id) that join the groups which the links found make; with these all
    documents of a bucket that near pairs of it link are linked.

    Of equal texts one stands for the others, which are linked to it. Each block of a bucket meets each, so neither a task nor a table holds a bucket's pairs."""
    roots = components(found, "a", "b").withColumnRenamed("node", "doc_id")
    rows = rows.distinct()
    held = rows.select("doc_id").distinct()
    n = held.count()
    held = with_ids(held, roots, "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"))
    rows = work.keep("grouped", rows.join(held, "doc_id"))
    open_ = rows.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    rows = work.keep("parted", rows.join(open_, "band"))
    ids = rows.select("doc_id").distinct()
    prints = work.keep("open-prints", with_ids(texts, ids, "left_semi", n=n).select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("bytes")).distinct())
    firsts = prints.groupBy("digest").agg(F.min("doc_id").alias("a"))
    copies = prints.where("bytes > 0").join(firsts, "digest").where("a < doc_id")
    # blank texts are near nothing; those of a repeated doc_id may be among these
    equal = _verified(work, "equal", texts, copies.select("a", F.col("doc_id").alias("b")), threshold)
    stand = rows.join(prints, "doc_id").groupBy("band", "digest").agg(F.min(F.struct("doc_id", "root", "bytes")).alias("one")).select("band", "digest", "one.*")
    sizes = stand.groupBy("band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    stand = stand.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("digest"), "blocks"))
    sides = stand.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sides = work.keep("sides", sides.select("band", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "doc_id", "digest", "root"))
    with_text = texts.withColumn("digest", F.unhex(F.sha2("text", 256))).dropDuplicates(["doc_id", "digest"])
    with_text = with_ids(with_text, ids, "left_semi", n=n)
    blocks = sides.join(with_text.hint("shuffle_merge"), ["doc_id", "digest"]).select("band", "i", "j", "block", "doc_id", "root", "text")
    joined = blocks.groupBy("band", "i", "j").applyInArrow(lambda table: _joining(table, threshold), "a long, b long, jaccard double")
    return work.keep("joined", joined).unionByName(equal)


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b, jaccard), a < b: pairs of doc_ids whose multisets of word pairs have sum(min) / sum(max) of `threshold` or more.

    Words are what ASCII white space parts; texts of one word have that word as their only element. In each bucket
    of each band all documents are compared with the one of the smallest doc_id. Those that aren't near it are compared with
    all of the bucket, if that has FEW members at most: so a near pair that shares such a bucket is given itself, unless
    both are near the bucket's first and linked through it. In larger buckets they are compared with the first of those that
    are left, and so on while that finds any, STAR_ROUNDS times at most, and with the next smaller member; what these links leave
    in different groups is compared each with each. So all near pairs that share a bucket of any size are linked, if not given themselves.

    Null, empty and blank texts are near nothing, not even each other; rows of null doc_id are left out; doc_id is cast to
    long, so it has to be a number. Rows that repeat a doc_id are one document, which is near whatever any of its rows is
    near. An empty table gives no rows; other columns are ignored; texts of any length are taken whole."""
    work = Work(docs.sparkSession, "near")
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = docs.where("text is not null")
    signed = work.keep("signed", texts.mapInArrow(lambda it: _bands(it, bands, rows), "band long, doc_id long"))
    members = work.keep("members", _first(signed))
    work.drop("signed")
    found = _verified(work, "first", texts, members.select("a", F.col("doc_id").alias("b")), threshold)

    def left(rows: DataFrame) -> DataFrame:
        """Rows that aren't near their a."""
        known = found.select("a", F.col("b").alias("doc_id"))
        return rows.join(known, ["a", "doc_id"], "left_anti")

    loose = work.keep("loose", left(members))
    few = loose.where(F.col("n") <= FEW).select("band", F.col("doc_id").alias("x"))
    each = few.join(members.where(F.col("n") <= FEW).select("band", F.col("doc_id").alias("y")), "band").where("x <> y")
    pairs = each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    many = loose.where(F.col("n") > FEW).select("band", "doc_id")
    hot = many.select("band").distinct()
    before = members.where(F.col("n") > FEW).join(hot, "band", "left_semi").select("band", "doc_id", F.lag("doc_id").over(Window.partitionBy("band").orderBy("doc_id")).alias("a")).join(many, ["band", "doc_id"], "left_semi")
    pairs = pairs.unionByName(before.where("a is not null and a <> doc_id").select("a", F.col("doc_id").alias("b")))
    more = _verified(work, "rest", texts, pairs.join(members.select("a", F.col("doc_id").alias("b")).distinct(), ["a", "b"], "left_anti"), threshold)
    found = found.unionByName(more)
    for i in range(STAR_ROUNDS):
        open_ = work.keep(f"open-{i}", _first(many))
        if not open_.limit(1).count():
            break
        new = _verified(work, f"star-{i}", texts, open_.select("a", F.col("doc_id").alias("b")), threshold)
        found = found.unionByName(new)
        if not new.limit(1).count():
            break
        many = work.keep(f"many-{i}", left(open_).select("band", "doc_id"))
    if hot.limit(1).count():
        large = members.where(F.col("n") > FEW).join(hot, "band", "left_semi").select("band", "doc_id")
        found = found.unionByName(_between_groups(work, texts, large, found, threshold))
    return found.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """near_pairs() as (doc_id, near_doc_id, jaccard), near_doc_id being the smaller one."""
    return near_pairs(docs, threshold).select(F.col("b").alias("doc_id"), F.col("a").alias("near_doc_id"), "jaccard")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id), a row for each doc_id: class_id is the smallest doc_id of its connected group of near pairs, its own where it is near nothing.

    doc_id is cast to long; rows of null doc_id are left out; null, empty and blank texts are near nothing; rows that repeat a
    doc_id are one document. See near_pairs for which pairs are told."""
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    groups = Work(docs.sparkSession, "classes").keep("classes", components(near_pairs(docs, threshold), "a", "b").select(F.col("node").alias("doc_id"), F.col("root").alias("class_id")))
    return with_ids(ids, groups, "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def without_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents, all columns, without those of each connected group of near pairs but the one of the smallest doc_id.

    Rows of null doc_id, and of null, empty or blank text, stay. All rows of a doc_id stay or go together."""
    key = fresh(docs, "near")[0]
    gone = Work(docs.sparkSession, "groups").keep("gone", components(near_pairs(docs, threshold), "a", "b").select(F.col("node").alias(key)).distinct())
    return with_ids(docs.withColumn(key, F.col("doc_id").cast("long")), gone, "left_anti", key).select(*[F.col(f"`{c}`") for c in docs.columns])
