"""Gap filling and neighbour expansion of selected chunks.

Joins find what may come in: chunks between two selected ones of a document (by the next one's index, so that the range becomes a
sequence and the join an equality) and chunks beside selected ones. Who does come in depends on who came before, so the budgets are
kept by a fold over the few rows of each query."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.config import Config, tokens_to_chars
from lodestar.functions.arrow import pieces


def gap_keys(candidates: DataFrame, width: int) -> DataFrame:
    """candidates(query_id, doc_id, chunk_index) -> keys between neighbours of one document that are at most `width` apart."""
    after = F.lead("chunk_index").over(Window.partitionBy("query_id", "doc_id").orderBy("chunk_index"))
    gap = after - F.col("chunk_index") - 1
    pairs = candidates.select("query_id", "doc_id", "chunk_index", after.alias("next"), gap.alias("gap")).where((F.col("gap") >= 1) & (F.col("gap") <= width))
    return pairs.select("query_id", "doc_id", F.explode(F.sequence(F.col("chunk_index") + 1, F.col("next") - 1)).alias("chunk_index"))


def neighbour_keys(selected: DataFrame, width: int) -> DataFrame:
    offsets = F.array(*[F.lit(o) for r in range(1, width + 1) for o in (-r, r)])
    spread = selected.select("query_id", "doc_id", "chunk_index", F.explode(offsets).alias("offset"))
    return spread.select("query_id", "doc_id", (F.col("chunk_index") + F.col("offset")).alias("chunk_index")).distinct()


def fill_gaps(candidates: DataFrame, store: DataFrame, width: int) -> DataFrame:
    """All chunks of the store within gaps, without a budget."""
    keys = ["query_id", "doc_id", "chunk_index"]
    return gap_keys(candidates, width).join(store.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_semi").select(*keys)


def expand(candidates: DataFrame, store: DataFrame, gap_width: int, width: int) -> DataFrame:
    """Candidates, gap rows and neighbours, without a budget: query_id, doc_id, chunk_index, origin."""
    keys = ["query_id", "doc_id", "chunk_index"]
    own = candidates.select(*keys).distinct()
    filled = fill_gaps(candidates, store, gap_width).select(*keys)
    both = own.unionByName(filled)
    beside = neighbour_keys(both, width).join(both, keys, "left_anti").join(store.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_semi").select(*keys)
    label = lambda df, name: df.withColumn("origin", F.lit(name))
    return label(own, "candidate").unionByName(label(filled, "gap")).unionByName(label(beside, "neighbour"))


def admitted(candidates: list[tuple], lengths: dict[tuple, int], config: Config) -> list[tuple[tuple, str]]:
    """(key, origin) of one query's chunks, in order; keys are (doc_id, chunk_index), lengths those of the store's chunks.

    Gaps first: a chunk over the character budget ends its own gap only. Then neighbours of all that is in, nearest first on the left, then on
    the right: one over the budget ends its chunk's turn. Both share a count of ratio times the candidates (rounded up) and the characters."""
    rows = sorted(set(candidates))
    if not rows or not lengths or (not config.gap_fill_width and not config.neighbor_width):
        return [(r, "candidate") for r in rows]
    most, room = int(len(candidates) * config.gap_fill_ratio + 0.9999), tokens_to_chars(config.gap_tokens)
    origin = {r: "candidate" for r in rows}
    order: list[tuple] = []
    count = 0
    for a, b in zip(rows, [*rows[1:], None]):
        order.append(a)
        if b is None or a[0] != b[0] or not 1 <= b[1] - a[1] - 1 <= config.gap_fill_width:
            continue
        for i in range(a[1] + 1, b[1]):
            if count >= most:
                break
            key = (a[0], i)
            if key not in lengths:
                continue
            if lengths[key] > room:
                break
            room, count = room - lengths[key], count + 1
            origin[key] = "gap"
            order.append(key)
    for doc, i in order:
        if count >= most:
            break
        for step in [*range(-1, -config.neighbor_width - 1, -1), *range(1, config.neighbor_width + 1)]:
            if count >= most:
                break
            key = (doc, i + step)
            if key not in lengths or key in origin:
                continue
            if lengths[key] > room:
                break
            room, count = room - lengths[key], count + 1
            origin[key] = "neighbour"
    return sorted(origin.items())


def fill(candidates: DataFrame, store: DataFrame, config: Config = Config()) -> DataFrame:
    """candidates(query_id, doc_id, chunk_index) and store(doc_id, chunk_index, length) -> query_id, doc_id, chunk_index, origin within the budgets.

    Of a chunk that is in the store several times the last one counts: by `ord`, where the store has that column, else the longest."""
    keys = ["query_id", "doc_id", "chunk_index"]
    kind = {f: candidates.schema[f].dataType.simpleString() for f in keys}
    own = candidates.select(*keys)
    near = gap_keys(own, config.gap_fill_width).unionByName(own)
    if config.neighbor_width:
        near = near.unionByName(neighbour_keys(near, config.neighbor_width))
    last = F.max_by("length", "ord") if "ord" in store.columns else F.max("length")
    sized = store.groupBy("doc_id", "chunk_index").agg(last.alias("length"))
    eligible = near.distinct().join(sized, ["doc_id", "chunk_index"]).select(*keys, "length", F.lit(False).alias("mine"))
    every = eligible.unionByName(own.select(*keys, F.lit(None).cast("int").alias("length"), F.lit(True).alias("mine")))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            out = []
            for query, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lengths = {(r["doc_id"], r["chunk_index"]): r["length"] for r in rows if not r["mine"]}
                got = admitted([(r["doc_id"], r["chunk_index"]) for r in rows if r["mine"]], lengths, config)
                out += [(query, d, i, o) for (d, i), o in got]
            columns = list(zip(*out)) if out else [()] * 4
            types = [batch.schema.field(0).type, *(batch.schema.field(1).type.value_type.field(f).type for f in ("doc_id", "chunk_index")), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[*keys, "origin"])

    rows = every.groupBy("query_id").agg(F.collect_list(F.struct("doc_id", "chunk_index", "length", "mine")).alias("rows"))
    return rows.mapInArrow(fold, ", ".join(f"{k} {kind[k]}" for k in keys) + ", origin string")
