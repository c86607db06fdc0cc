"""Suffix-array dedup: passages of WORDS words or more that occur at two places of the corpus or more.

Winnowed anchors, of which every passage of that length holds one in each of its copies, tell which parts of which
documents can repeat at all; only these travel. A part goes to the shards of the anchors it holds, so all copies of a
window meet in the shard of its own anchor (its least k-gram), where induced sorting makes the suffix array and
neighbours with a long enough common prefix are repeats; other shards, which may hold some of the copies only, don't report
it. Text that shares no anchor with other text repeats nothing; no repeat is lost by leaving it out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.hashing import PLAIN, U, gram_rows, grams, least_of, run_hashes, slices, winnow, words
from lodestar.llm.shared import Work, with_lists
from lodestar.llm.suffix_array import permuted_lcp, suffix_array

#: Least length of a repeat, in words.
WORDS = 50
#: Words of a part that travels, beyond the overlap that keeps each window of WORDS words whole; words of one suffix array.
PART, ARRAY = 512, 200_000
#: Anchors in more places than this are hot: their windows are counted by a hash of all words, not sorted in one task.
HOT = 4096
NONE = np.iinfo(np.int64).max


def _anchor_size(least: int) -> int:
    return max(1, least // 3)


def _anchors(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    k = _anchor_size(least)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for begin, _, data, off in slices(batch.column(1)):
            h, _, _, first = words(data, off, PLAIN)
            at, rows = gram_rows(first, k)
            long = np.diff(first)[rows] >= least
            at, rows = at[long], rows[long]
            if not len(at):
                continue
            g = grams(h, k)[at]
            keep = winnow(g, rows, least - k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(g[keep].view(np.int64)), pa.array(ids[begin + rows[keep]]), pa.array((at[keep] - first[rows[keep]]).astype(np.int32))], names=["anchor", "doc_id", "pos"])


def _parts(batches: Iterator[pa.RecordBatch], least: int, part: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, marks: [(pos, shard)]) -> (shard, doc_id, at, text, anchors): the parts of the text around its anchors, once for each of their shards, with where those lie."""
    k = _anchor_size(least)
    for batch in batches:
        out: list[tuple[int, int, int, bytes, np.ndarray]] = []
        ids, marks = batch.column(0).to_pylist(), batch.column(2)
        for begin, end, data, off in slices(batch.column(1)):
            _, starts, ends, first = words(data, off, PLAIN)
            raw = data.tobytes()
            for row in range(begin, end):
                base, n = int(first[row - begin]), int(first[row - begin + 1] - first[row - begin])
                mark = marks[row].values
                pos, shard = mark.field(0).to_numpy(), mark.field(1).to_numpy()
                fits = pos + k <= n  # a row that repeats a doc_id may be shorter
                pos, shard = pos[fits], shard[fits]
                if not len(pos):
                    continue
                order = np.argsort(pos, kind="stable")
                pos, shard = pos[order], shard[order]
                low, high = np.maximum(pos - (least - k), 0), np.minimum(pos + least, n)
                new = np.append(True, low[1:] > high[:-1])
                for lo, hi in zip(low[new].tolist(), high[np.append(np.flatnonzero(new)[1:] - 1, len(pos) - 1)].tolist()):
                    for s in range(lo, max(lo + 1, hi - least + 1), part):
                        e = min(s + part + least - 1, hi)
                        if e - s < least:
                            continue
                        inside = (pos >= s) & (pos + k <= e)
                        piece = raw[starts[base + s] : ends[base + e - 1]]
                        p, q = pos[inside] - s, shard[inside]
                        out += [(x, ids[row], s, piece, p[q == x]) for x in np.unique(q).tolist()]
            if len(out) > 2000:
                yield _part_batch(out)
                out = []
        if out:
            yield _part_batch(out)


def _part_batch(out: list[tuple]) -> pa.RecordBatch:
    shard, doc, at, text, anchors = zip(*out)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(a) for a in anchors])).astype(np.int32)), pa.array(np.concatenate(anchors).astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(text, pa.binary()).cast(pa.string()), lists], names=["shard", "doc_id", "at", "text", "anchors"])


def _sort_shards(batches: Iterator[pa.RecordBatch], least: int, array: int) -> Iterator[pa.RecordBatch]:
    """(shard, doc_id, at, text, anchors), sorted by shard -> (doc_id, start, end, other_id)."""
    held: Held = {}  # equal parts are sorted once
    count, last = 0, None
    for batch in batches:
        shards, docs, ats = (batch.column(i).to_numpy() for i in range(3))
        anchors, bounds = batch.column(4).values.to_numpy(), batch.column(4).offsets.to_numpy()
        for begin, _, data, off in slices(batch.column(3)):
            h, _, _, first = words(data, off, PLAIN)
            for i in range(len(off) - 1):
                row = begin + i
                if shards[row] != last and count > array:
                    yield _repeats(held, least)
                    held, count = {}, 0
                last = shards[row]
                body = h[first[i] : first[i + 1]].tobytes()
                found = held.get(body)
                if found is None:
                    held[body] = found = ([], set())
                    count += len(body) // 8
                found[0].append((int(docs[row]), int(ats[row])))
                found[1].update(anchors[bounds[row] : bounds[row + 1]].tolist())
    if held:
        yield _repeats(held, least)


#: (doc_id, first word) of the places of a part, and where in it anchors of the shards at hand lie; by the words' hashes.
Held = dict[bytes, tuple[list[tuple[int, int]], set[int]]]


def _complete(h: np.ndarray, lengths: np.ndarray, anchors: list[set[int]], least: int) -> np.ndarray:
    """Whether the anchor of the window that begins at a word belongs to the shards at hand, so that all copies of the window are here."""
    k = _anchor_size(least)
    first = np.append(0, np.cumsum(lengths))
    marked = np.zeros(len(h), bool)
    marked[np.concatenate([np.fromiter(a, np.int64, len(a)) + f for a, f in zip(anchors, first)])] = True
    at, rows = gram_rows(first, k)
    out = np.zeros(len(h), bool)
    out[at] = marked[at[least_of(grams(h, k)[at], rows, least - k + 1)]]
    return out


def _repeats(held: Held, least: int) -> pa.RecordBatch:
    places = [sorted(set(p)) for p, _ in held.values()]
    lengths = np.array([len(b) // 8 for b in held])
    h = np.frombuffer(b"".join(held), U)
    m = len(places)
    # each part ends in a mark of its own, so that no common prefix runs over an end
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    part = np.repeat(np.arange(m), lengths + 1)
    n = len(part)
    values, rank = np.unique(h, return_inverse=True)
    s = np.empty(n, np.int64)
    mark = begins + lengths
    s[mark] = np.arange(m)
    word = np.ones(n, bool)
    word[mark] = False
    s[word] = rank + m
    text = s.tolist()
    sa = suffix_array(text, m + len(values) - 1)
    lcp = np.asarray(permuted_lcp(text, sa))
    order = np.asarray(sa)
    # blocks: neighbours in the array that share `least` words
    block = np.cumsum(lcp[order] < least) - 1
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    docs = [list(dict.fromkeys(d for d, _ in p)) for p in places]
    one = np.array([d[0] for d in docs])
    two = np.array([d[1] if len(d) > 1 else NONE for d in docs])
    many = np.array([len(p) for p in places])
    of = part[order]
    least_doc = np.minimum.reduceat(one[of], starts)[block]
    second = np.where(one[of] == least_doc, two[of], one[of])
    second_doc = np.minimum.reduceat(second, starts)[block]
    total = np.add.reduceat(many[of], starts)[block]
    complete = np.zeros(n, bool)
    complete[word] = _complete(h, lengths, [a for _, a in held.values()], least)
    good = (total > 1) & (order + least <= mark[of]) & complete[order]
    at = order[good]
    by_text = np.argsort(at)
    at, first_doc, next_doc = at[by_text], least_doc[good][by_text], second_doc[good][by_text]
    which = part[at]
    bounds = np.searchsorted(which, np.arange(m + 1))
    out: list[np.ndarray] = []
    for p in range(m):
        lo, hi = bounds[p], bounds[p + 1]
        if lo == hi:
            continue
        w = at[lo:hi] - begins[p]
        for doc, begin in places[p]:
            other = np.where(first_doc[lo:hi] != doc, first_doc[lo:hi], np.where(next_doc[lo:hi] != NONE, next_doc[lo:hi], doc))
            new = np.flatnonzero(np.append(True, (w[1:] != w[:-1] + 1) | (other[1:] != other[:-1])))
            stop = np.append(new[1:] - 1, len(w) - 1)
            out.append(np.stack([np.full(len(new), doc), begin + w[new], begin + w[stop] + least, other[new]]))
    rows = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)) for r in rows], names=["doc_id", "start", "end", "other_id"])


def _hot_windows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, marks: [pos]) -> (window, start, doc_id): hashes of the windows of `least` words whose own anchor is at one of the places."""
    k = _anchor_size(least)
    for batch in batches:
        ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
        places, bounds = marks.values.to_numpy(), marks.offsets.to_numpy()
        for begin, end, data, off in slices(batch.column(1)):
            h, _, _, first = words(data, off, PLAIN)
            at, rows = gram_rows(first, k)
            if not len(at):
                continue
            count = np.maximum(np.diff(first) - k + 1, 0)
            base = np.cumsum(count) - count
            marked = np.zeros(len(at), bool)
            for row in range(begin, end):
                pos = places[bounds[row] : bounds[row + 1]]
                marked[base[row - begin] + pos[pos < count[row - begin]]] = True
            best = least_of(grams(h, k)[at], rows, least - k + 1)
            mine = np.flatnonzero(marked[best] & (at + least <= first[1:][rows]))
            start = at[mine]
            yield pa.RecordBatch.from_arrays([pa.array(run_hashes(h, start, least).view(np.int64)), pa.array((start - first[rows[mine]]).astype(np.int64)), pa.array(ids[begin + rows[mine]])], names=["window", "start", "doc_id"])


def _hot_spans(work: Work, docs: DataFrame, hot: DataFrame, least: int) -> DataFrame:
    """(doc_id, start, end, other_id) of the windows of hot anchors: counted before they are shuffled, and joined in a way that Spark splits where a window is hot."""
    marks = work.keep("hot-marks", hot.groupBy("doc_id").agg(F.collect_list("pos").alias("marks")))
    windows = with_lists(docs, marks).select("doc_id", "text", "marks").mapInArrow(lambda it: _hot_windows(it, least), "window long, start long, doc_id long")
    windows = work.keep("windows", windows)
    firsts = windows.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("lo"), F.max(F.struct("doc_id", "start")).alias("hi")).where("lo < hi").select("window", F.col("lo.doc_id").alias("one"))
    told = work.keep("hot", windows.join(firsts.hint("merge"), "window"))
    second = told.where("doc_id <> one").groupBy("window").agg(F.min("doc_id").alias("two"))
    other = F.when(F.col("doc_id") != F.col("one"), F.col("one")).otherwise(F.coalesce("two", "doc_id"))
    return told.join(second.hint("merge"), "window", "left").select("doc_id", "start", (F.col("start") + least).alias("end"), other.alias("other_id"))


def merged(spans: DataFrame, *by: str, overlap: int = 0) -> DataFrame:
    """Spans (start, end) of equal `by` that touch, or overlap by `overlap` at least, made one."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col("start") > F.coalesce(before - overlap, F.lit(-1))).cast("int")
    island = F.sum("_apart").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("_apart", apart).withColumn("_island", island).groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def repeats(docs: DataFrame, least: int = WORDS, part: int = PART, array: int = ARRAY) -> DataFrame:
    """(doc_id, other_id, start, end, n_words): parts of documents, in words from 0, of which each window of `least` words
    occurs elsewhere too. other_id is the smallest other doc_id that holds the windows, or doc_id itself if only it does.

    Words are what ASCII white space parts, compared by 64-bit hashes of their bytes; a repeat can be of any length. All places of a
    repeat are given, the first too. Windows whose anchor is in over HOT places are counted instead of sorted; the rows are the same. Null, empty and short texts hold no repeats; rows of null doc_id are left out; doc_id is cast to long, so it has to be a number; rows
    that repeat a doc_id and text are one document, and of rows with one doc_id and several texts each is searched. An
    empty table gives no rows; other columns are ignored."""
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    work = Work(docs.sparkSession, "repeats")
    anchors = work.keep("anchors", docs.mapInArrow(lambda it: _anchors(it, least), "anchor long, doc_id long, pos int"))
    # counted before they are shuffled, and joined in a way that Spark splits where an anchor is hot
    firsts = anchors.groupBy("anchor").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    shard = F.xxhash64("first.doc_id", F.floor(F.col("first.pos") / 256)).alias("shard")
    linked = work.keep("linked", anchors.join(firsts.hint("merge"), "anchor").select("doc_id", "pos", shard, (F.col("n") > HOT).alias("hot")))
    work.drop("anchors")
    marks = work.keep("marks", linked.where("not hot").groupBy("doc_id").agg(F.collect_list(F.struct("pos", "shard")).alias("marks")))
    parts = with_lists(docs, marks).select("doc_id", "text", "marks").mapInArrow(lambda it: _parts(it, least, part), "shard long, doc_id long, at int, text string, anchors array<int>")
    sorted_ = parts.repartition(F.col("shard")).sortWithinPartitions("shard")
    spans = sorted_.mapInArrow(lambda it: _sort_shards(it, least, array), "doc_id long, start long, end long, other_id long")
    hot = linked.where("hot")
    if hot.limit(1).count():
        spans = work.keep("spans", spans).unionByName(_hot_spans(work, docs, hot, least))
    return merged(spans, "doc_id", "other_id", overlap=least - 1).select("doc_id", "other_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"))
