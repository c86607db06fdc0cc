"""Byte-level BPE as a monoid: the tokens of a text are joined from those of its halves, and decoding concatenates up the same tree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestar.llm.vocabulary import PATH, encoding, sizes

#: Characters of a leaf, and those looked at first on either side of a border.
LEAF, REACH = 8192, 64
#: Places where every parting of the text has a border, whatever stands around: after a letter that no letter follows, a
#: digit that no digit follows, or another mark (but a quote, which can open a contraction) that no other mark follows.
_BORDER = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\p{White_Space}\p{L}\p{N}'])(?=[\p{White_Space}\p{L}\p{N}])")


def join(text: str, begin: int, middle: int, end: int, a: list[int], b: list[int], path: str = PATH) -> list[int]:
    """Tokens of text[begin:end] from those of text[begin:middle] and of text[middle:end].

    A window about the middle grows until a certain border lies on both of its sides (or the text ends there). What lies
    outside the borders is merged by itself on either side, so its tokens are those of the whole; the window is encoded anew."""
    reach = REACH
    while True:
        lo, hi = max(begin, middle - reach), min(end, middle + reach)
        # a border needs the characters on both of its sides: search one character further
        left = [m.start() for m in _BORDER.finditer(text, max(begin, lo - 1), middle) if lo <= m.start() < middle]
        right = next((m.start() for m in _BORDER.finditer(text, middle, min(end, hi + 1)) if m.start() > middle), None)
        p = left[-1] if left else begin if lo == begin else None
        q = right if right is not None else end if hi == end else None
        if p is not None and q is not None:
            break
        reach *= 2
    size = sizes(path)
    cut, rest = len(a), len(text[p:middle].encode())
    while rest > 0:
        cut -= 1
        rest -= size[a[cut]]
    skip, rest2 = 0, len(text[middle:q].encode())
    while rest2 > 0:
        rest2 -= size[b[skip]]
        skip += 1
    if rest or rest2:
        raise AssertionError("a token lies across a certain border")
    return a[:cut] + encoding(path).encode_ordinary(text[p:q]) + b[skip:]


def encode(text: str, path: str = PATH, leaf: int = LEAF) -> list[int]:
    """The tokens of the text; those of leaves up to `leaf` characters are found at once, all others by join()."""

    def tree(begin: int, end: int) -> list[int]:
        if end - begin <= max(1, leaf):
            return encoding(path).encode_ordinary(text[begin:end])
        middle = (begin + end) // 2
        return join(text, begin, middle, end, tree(begin, middle), tree(middle, end), path)

    return tree(0, len(text))


def decode(tokens: list[int], path: str = PATH, leaf: int = LEAF) -> bytes:
    """The bytes of the tokens: concatenation is the monoid's operation, so halves need no window."""

    def tree(begin: int, end: int) -> bytes:
        if end - begin <= max(1, leaf):
            return encoding(path).decode_bytes(tokens[begin:end])
        middle = (begin + end) // 2
        return tree(begin, middle) + tree(middle, end)

    return tree(0, len(tokens))


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, begin, rows, decoded, size = batch.column(1), 0, [], [], 0
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            rows.append(None if text is None else encode(text, path))
            decoded.append(None if text is None else decode(rows[-1], path).decode())
            size += 0 if text is None else len(text)
            if size > 1 << 20 or i == batch.num_rows - 1:
                n = pa.array([None if r is None else len(r) for r in rows], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(rows)), n, pa.array(rows, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "tokens", "decoded"])
                begin, rows, decoded, size = i + 1, [], [], 0


def encode_documents(docs: DataFrame, path: str = PATH) -> DataFrame:
    """(doc_id, n_tokens, tokens, decoded) of each row of documents; decoded is the text again, from the tokens.

    A null text has nulls; an empty one no tokens and "". Every row has its own, so repeated rows repeat and a null doc_id
    stays null. An empty table gives no rows; other columns are ignored; a text of any length is encoded whole."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _encoded(it, path), f"doc_id {kind}, n_tokens int, tokens array<int>, decoded string")
