"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

Within one part of the text that BPE merges by itself, the tokens of a prefix are those of a shorter prefix and one more
token, its last; which one is told by the pair rule: two tokens stand side by side in an encoding exactly if BPE
doesn't merge across their border. So one pass over the ends of prefixes, each looking at the tokens that end there,
gives the last token and the count of every prefix. Parts are remembered, as most words come again and again."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.vocabulary import PATH, PATTERN, ranks

#: Texts of these characters only are parted by the faster module; the patterns agree on them.
_PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ɏ]")
_L, _W = "A-Za-zÀ-ÖØ-öø-ɏ", "\t\n\r "
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^{_W}{_L}0-9]+|[{_W}]+(?![^{_W}])|[{_W}]+")
_FULL = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"[^\p{White_Space}", r"[^\p{White_Space}"))
_RUN = regex.compile(r"\p{White_Space}{2,}(?=\P{White_Space})")
_FAST_RUN = re.compile(rf"[{_W}]{{2,}}(?=[^{_W}])")
#: Parts remembered by a worker.
REMEMBERED = 400_000


class PrefixCounter:
    def __init__(self, path: str = PATH) -> None:
        self.rank = ranks(path)
        self.token = {rank: token for token, rank in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.parts: dict[str, bytes] = {}

    def split(self, t: int) -> tuple[int, int] | None:
        """The two tokens whose merge is t; None for a single byte."""
        if t not in self.halves:
            piece = [bytes([x]) for x in self.token[t]]
            while len(piece) > 2:
                best = min(range(len(piece) - 1), key=lambda i: (self.rank.get(piece[i] + piece[i + 1], 1 << 60), i))
                piece[best : best + 2] = [piece[best] + piece[best + 1]]
            self.halves[t] = (self.rank[piece[0]], self.rank[piece[1]]) if len(piece) == 2 else None
        return self.halves[t]

    def pair(self, a: int, b: int) -> bool:
        """Whether BPE keeps the border between the tokens a and b: undoes their merges, latest first, and looks for an earlier merge across it."""
        found = self.beside.get((a, b))
        if found is None:
            x, y, limit = a, b, 1 << 60
            found = None
            while found is None:
                across = self.rank.get(self.token[x] + self.token[y])
                if across is not None and across < limit:
                    found = False
                    break
                sx, sy = self.split(x), self.split(y)
                if sx is None and sy is None:
                    found = True
                elif sy is None or (sx is not None and x > y):
                    limit, x = x, sx[1]
                else:
                    limit, y = y + 1, sy[0]
            if len(self.beside) > 2_000_000:
                self.beside.clear()
            self.beside[a, b] = found
        return found

    def counts(self, part: bytes) -> list[int]:
        """Token counts of the prefixes of 1, 2, ... bytes of a part that is merged by itself."""
        n = len(part)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        get, longest, beside = self.rank.get, self.longest, self.beside
        for end in range(1, n + 1):
            for begin in range(end - 1, max(0, end - longest) - 1, -1):
                t = get(part[begin:end])
                if t is None:
                    continue
                if begin:
                    ok = beside.get((last[begin], t))
                    if not (self.pair(last[begin], t) if ok is None else ok):
                        continue
                last[end], count[end] = t, count[begin] + 1
                break
        return count[1:]

    def part(self, text: str) -> bytes | np.ndarray:
        """Counts after each character of a part: as bytes, which are remembered, or as numbers where one doesn't fit a byte."""
        raw = text.encode()
        if text in ("'re", "'ve", "'ll"):  # two of the three characters are a quote and a word
            found = bytes([1, 2, self.counts(raw)[-1]])
        else:
            count = self.counts(raw)
            if len(raw) != len(text):
                ends = np.cumsum([len(c.encode()) for c in text])
                count = [count[e - 1] for e in ends.tolist()]
            if max(count) > 255:
                return np.asarray(count, np.int32)
            found = bytes(count)
        if len(self.parts) >= REMEMBERED:
            self.parts.clear()
        self.parts[text] = found
        return found

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of the prefixes of 0, 1, 2, ... characters."""
        out = np.zeros(len(text) + 1, np.int32)
        if not text:
            return out
        plain = _PLAIN.search(text) is None
        parts = (_FAST if plain else _FULL).findall(text)
        get, make = self.parts.get, self.part
        known = [get(p) or make(p) for p in parts]
        if any(type(k) is not bytes for k in known):
            inner = np.concatenate([np.frombuffer(k, np.uint8).astype(np.int32) if type(k) is bytes else k for k in known])
        else:
            inner = np.frombuffer(b"".join(known), np.uint8).astype(np.int32)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        total = inner[np.cumsum(size) - 1]
        out[1:] = inner + np.repeat(np.cumsum(total) - total, size)
        # white space before a word loses its last character to the word or to a part of its own; a prefix that ends there keeps it
        for run in (_FAST_RUN if plain else _RUN).finditer(text):
            out[run.end()] = out[run.start()] + self.counts(run.group().encode())[-1]
        return out


_counters: dict[str, PrefixCounter] = {}


def counter(path: str = PATH) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    one = counter(path)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        begin, rows, size = 0, [], 0
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            rows.append(None if text is None else one.prefixes(text))
            size += 0 if text is None else len(text)
            if size > 1 << 20 or i == batch.num_rows - 1:
                n = [0 if r is None else len(r) for r in rows]
                flat = np.concatenate([r for r in rows if r is not None] or [np.zeros(0, np.int32)])
                missing = pa.array([r is None for r in rows])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(flat), mask=missing)
                last = pa.array([None if r is None else int(r[-1]) for r in rows], pa.int32())
                yield pa.RecordBatch.from_arrays([ids.slice(begin, len(rows)), last, lists], names=["doc_id", "n_tokens", "prefix_tokens"])
                begin, rows, size = i + 1, [], 0


def token_counts(docs: DataFrame, path: str = PATH) -> DataFrame:
    """(doc_id, n_tokens, prefix_tokens) of each row of documents; prefix_tokens[i] is the number of tokens of the first i characters alone.

    A null text has null counts; an empty one has 0 tokens and [0]. Every row has its own, so repeated rows repeat and a null
    doc_id stays null. An empty table gives no rows; other columns are ignored; a text may be as long as an array can be
    (over 2 billion characters), and time is in proportion to its length."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _counted(it, path), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens int, prefix_tokens array<int>")


def tokens_before(prefix_tokens: Column, characters: Column) -> Column:
    """Tokens of the first `characters` characters; null where that is negative or more than there are, and of a null."""
    return F.try_element_at(prefix_tokens, F.when(characters >= 0, (characters + 1).cast("int")))


def longest_prefix(prefix_tokens: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most `budget` tokens; null where that is negative, as no prefix fits, and of a null."""
    fits = F.array_position(F.transform(F.reverse(prefix_tokens), lambda n: n <= budget), F.lit(True))
    return F.when(fits > 0, F.size(prefix_tokens) - fits).cast("int")
