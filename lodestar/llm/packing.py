"""Best-fit packing by best-two-fit: a bin is filled greedily with the largest documents that fit; then its smallest
document gives way to the two unpacked ones that fill the gap it leaves most tightly, where they fill it better."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import Work
from lodestar.llm.vocabulary import PATH, encoding

#: Tokens of a training sequence, and tokens packed as one shard. Bins don't span shards; a shard is some 2000 bins.
CAPACITY = 4096
SHARD = 2048 * CAPACITY


def best_two_fit(pieces: list[tuple[int, tuple]], capacity: int) -> list[list[tuple[int, tuple]]]:
    """Bins of (size, name). Sizes are from 1 to capacity; of equal ones the least name goes first."""
    stacks: dict[int, list[tuple]] = {}
    for size, name in pieces:
        stacks.setdefault(size, []).append(name)
    for names in stacks.values():
        heapify(names)
    there = 0  # bit s: a piece of size s is unpacked
    for size in stacks:
        there |= 1 << size

    def largest(most: int) -> int:
        return (there & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else -1

    def take(size: int) -> tuple[int, tuple]:
        nonlocal there
        name = heappop(stacks[size])
        if not stacks[size]:
            there &= ~(1 << size)
        return size, name

    bins = []
    while there:
        gap, held = capacity, []
        while (size := largest(gap)) > 0:
            held.append(take(size))
            gap -= size
        if gap and len(held) > 1 and there:
            out, room = held[-1][0], gap + held[-1][0]
            best = (out, 0, 0)  # only a fuller bin is better
            a = largest(room - 1)
            while a > 0 and 2 * a > best[0]:  # a is the larger one of the two
                b = largest(min(a, room - a))
                if b == a and len(stacks[a]) < 2:
                    b = largest(min(a - 1, room - a))
                if b > 0 and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                a = largest(a - 1)
            if best[1]:
                size, name = held.pop()
                held += [take(best[1]), take(best[2])]
                heappush(stacks[size], name)
                there |= 1 << size
        bins.append(held)
    return bins


def _sized(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder = encoding(path)
    for batch in batches:
        sizes = [len(encoder.encode_ordinary(x.as_py())) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(2)], names=["doc_id", "size", "lane"])


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, path: str = PATH) -> DataFrame:
    """Bins of at most `capacity` tokens that hold all of documents' texts: shard, bin, used, n_docs, and
    doc_ids, starts, sizes of its pieces in the order they were packed.

    A text over the capacity is cut into pieces of that size and a rest; starts are in tokens. Documents are
    spread over shards by a hash of doc_id and text, as many as the tokens of all texts ask for, and each shard is packed
    by itself. doc_id is cast to long, so it has to be a number. A null or empty text takes no room and is in no bin. Rows of null doc_id are packed, under null;
    rows that repeat a doc_id are each packed. Ties of size go by doc_id (null last), then start. An empty table
    gives no bins; other columns are ignored."""
    texts = docs.where("text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("lane", F.xxhash64("doc_id", "text"))
    sized = Work(docs.sparkSession, "packing").keep("sized", texts.mapInArrow(lambda it: _sized(it, path), "doc_id long, size long, lane long"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard))
    lanes = sized.withColumn("shard", F.pmod("lane", F.lit(shards)).cast("long")).drop("lane")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        pieces = []
        for doc, size in zip(group["doc_id"].tolist(), group["size"].tolist()):
            nameless = doc is None or doc != doc
            for start in range(0, size, capacity):
                pieces.append((min(capacity, size - start), (nameless, 0 if nameless else int(doc), start)))
        bins = best_two_fit(pieces, capacity)
        rows = [(int(group["shard"].iloc[0]), i, sum(s for s, _ in b), len(b), [None if n[0] else n[1] for _, n in b], [n[2] for _, n in b], [s for s, _ in b]) for i, b in enumerate(bins)]
        return pd.DataFrame(rows, columns=["shard", "bin", "used", "n_docs", "doc_ids", "starts", "sizes"])

    # doc_id as decimal, lest pandas make floats of it where some are null
    lanes = lanes.withColumn("doc_id", F.col("doc_id").cast("string"))
    # a partition for each 8 shards, some 64 million tokens, but no fewer than the session asks for; by the bytes of so narrow a table there would be few tasks
    lanes = lanes.repartition(min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // 8))), "shard")
    return lanes.groupBy("shard").applyInPandas(one, "shard long, bin long, used long, n_docs int, doc_ids array<long>, starts array<long>, sizes array<long>")
