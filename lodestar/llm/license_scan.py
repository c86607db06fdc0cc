"""Licence scan by a positional index of rare words: a file's rarest licence words are looked up, the places they point to in
the templates are intersected by relative position, and the phrases a template must have are checked word for word."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.hashing import ALNUM, U, slices, words
from lodestar.llm.license_templates import TEMPLATES

#: Rarest words of a template that are looked up in a file, and by how many words their places may drift from the template's.
RARE, DRIFT = 8, 12
#: Share of a template's words that a match holds.
SCORE = 0.5


def plain_words(text: str) -> list[str]:
    """Words as the scan sees them: runs of ASCII letters and digits, in lower case, and of other characters."""
    return [w.decode().lower() if w.isascii() else w.decode() for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", text.encode())]


def hashes(tokens: list[str]) -> np.ndarray:
    data = " ".join(tokens).encode()
    return words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM)[0]


class Index:
    """Postings of the templates' words, by the words' hashes, with each word's rarity in the corpus."""

    def __init__(self, templates: list[tuple[str, str, list[str]]], df: dict[int, int] | None = None, n: int = 0) -> None:
        self.names = [t[0] for t in templates]
        self.texts = [hashes(plain_words(t[1])).tolist() for t in templates]
        self.phrases = [[hashes(plain_words(p)).tolist() for p in t[2]] for t in templates]
        self.places = [[(self._find(text, p) or [0])[0] for p in phrases] for text, phrases in zip(self.texts, self.phrases)]
        self.vocabulary = np.array(sorted({w for t in self.texts for w in t} | {w for t in self.phrases for p in t for w in p}), U)
        df = df or {}
        self.idf = {w: log((n + 1) / (df.get(w, 0) + 1)) for w in self.vocabulary.tolist()}
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, text in enumerate(self.texts):
            for at, w in enumerate(text):
                self.postings[w].append((t, at))
        # a file without the rarest word of each phrase of a template lacks a phrase: it can't match
        self.keys = [[max(p, key=lambda w: (self.idf[w], w)) for p in phrases] for phrases in self.phrases]
        self.needed = np.array(sorted({w for k in self.keys for w in k}), U)

    def known(self, h: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Which of the hashes are among `of` (sorted)."""
        if not len(of):
            return np.zeros(len(h), bool)
        return of[np.minimum(np.searchsorted(of, h), len(of) - 1)] == h

    def scan(self, h: list[int]) -> list[tuple[str, int, int, float]]:
        """(licence, start, end, score) in one file, from its words' hashes; of overlapping matches of a licence the one of most words."""
        places: dict[int, list[int]] = defaultdict(list)
        for at, w in enumerate(h):
            if w in self.idf:
                places[w].append(at)
        found = []
        for t, text in enumerate(self.texts):
            if not all(k in places for k in self.keys[t]):
                continue
            rare = set(sorted({w for w in text if w in places}, key=lambda w: (-self.idf[w], w))[:RARE])
            # (shift, place in the template): where the template would begin if this word stood at its place
            pairs = sorted((place - at, at) for at, w in enumerate(text) if w in rare for place in places[w])
            votes = Counter(shift for shift, _ in pairs)
            need = max(1, (len(rare) + 1) // 2)
            first = last = 0
            tried = set()
            while first < len(pairs):
                shift = pairs[first][0]
                while last < len(pairs) and pairs[last][0] <= shift + DRIFT:
                    last += 1
                near = pairs[first:last]
                first += votes[shift]
                if len(near) < need:
                    continue
                # the best shift of these, and each that has enough votes of its own: two short notices may stand this close
                peaks = {max((s for s, _ in near), key=lambda s: (votes[s], -s)), *(s for s, _ in near if votes[s] >= need)} - tried
                tried |= peaks
                for peak in sorted(peaks):
                    if match := self._match(h, t, peak, near):
                        start, end, score = match
                        found.append((-score * len(text), -votes[peak], start, end, self.names[t], score))
        best = []
        for _, _, start, end, name, score in sorted(found):
            if not any(name == n and start < e and s < end for n, s, e, _ in best):
                best.append((name, start, end, score))
        return sorted(best, key=lambda x: (x[1], x[0]))

    def _match(self, h: list[int], t: int, peak: int, near: list[tuple[int, int]]) -> tuple[int, int, float] | None:
        """(start, end, score) of template t about the place where it would begin at `peak`, if its phrases are there."""
        text = self.texts[t]
        lo, hi = max(0, peak - DRIFT), min(len(h), peak + len(text) + 2 * DRIFT)
        window = h[lo:hi]
        at = []
        for phrase, place in zip(self.phrases[t], self.places[t]):
            found = self._find(window, phrase)
            if not found:
                return None
            at.append(min(found, key=lambda x: (abs(lo + x - peak - place), x)))
        score = sum((Counter(window) & Counter(text)).values()) / len(text)
        if score < SCORE:
            return None
        # the first and last of the rare words tell where the notice begins and ends, however it drifts between
        head = min(near, key=lambda x: (x[1], abs(x[0] - peak)))[0]
        tail = min(near, key=lambda x: (-x[1], abs(x[0] - peak)))[0]
        start = min(max(0, head), lo + min(at))
        end = max(min(len(h), tail + len(text)), lo + max(a + len(p) for a, p in zip(at, self.phrases[t])))
        return start, end, score

    @staticmethod
    def _find(window: list[int], phrase: list[int]) -> list[int]:
        """Where the phrase stands in the window."""
        n, head = len(phrase), phrase[0]
        return [i for i in range(len(window) - n + 1) if window[i] == head and window[i : i + n] == phrase]


def _frequencies(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(len(index.vocabulary), np.int64), np.zeros(len(index.vocabulary), np.int64)
    for batch in batches:
        n[0] += batch.num_rows  # in the first word's row, for all
        for _, _, data, off in slices(batch.column(0)):
            h, _, _, first = words(data, off, ALNUM)
            at = np.flatnonzero(index.known(h, index.vocabulary))
            rows = np.searchsorted(first, at, "right") - 1
            word = np.searchsorted(index.vocabulary, h[at])
            df += np.bincount(np.unique(rows * len(df) + word) % len(df), minlength=len(df))
    yield pa.RecordBatch.from_arrays([pa.array(index.vocabulary.view(np.int64)), pa.array(df), pa.array(n)], names=["word", "df", "n"])


def _scanned(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        ids = batch.column(0)
        for begin, _, data, off in slices(batch.column(1)):
            h, _, _, first = words(data, off, ALNUM)
            at = np.flatnonzero(index.known(h, index.needed))
            for row in np.unique(np.searchsorted(first, at, "right") - 1).tolist():
                out += [(ids[begin + row].as_py(), *x) for x in index.scan(h[first[row] : first[row + 1]].tolist())]
        columns = list(zip(*out)) if out else [()] * 5
        kinds = [batch.schema.types[0], pa.string(), pa.int32(), pa.int32(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "license", "start", "end", "score"])


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str, list[str]]] = TEMPLATES) -> DataFrame:
    """(doc_id, license, start, end, score): each place of a document where a licence's notice stands, in words from 0.

    Rarity is over all documents; the table of it has a row for each word of the templates, whatever the corpus. Words are
    runs of ASCII letters and digits without regard to case, or of other characters. score is the share of the template's words at the place.

    Null, empty and blank texts hold no licences. Each row is scanned by itself, so repeated rows give repeated rows, and
    a null doc_id stays null. A licence that stands in a document several times gives several rows; of matches of one licence that overlap
    the one of most matched words stays, of equal ones that of most rare words in place, then the first. An empty table gives no rows; other columns are ignored; texts of any length are scanned whole."""
    bare = Index(templates)
    texts = docs.where("text is not null").select("doc_id", "text")
    rows = texts.select("text").mapInArrow(lambda it: _frequencies(it, bare), "word long, df long, n long").groupBy("word").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect()
    df = {r.word & 0xFFFFFFFFFFFFFFFF: r.df for r in rows}
    index = Index(templates, df, sum(r.n for r in rows))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(lambda it: _scanned(it, index), f"doc_id {kind}, license string, start int, end int, score double")
