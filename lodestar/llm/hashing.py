"""Words of whole Arrow batches and their 64-bit hashes, in numpy, without a Python step for each word.

A word is a run of bytes that a 256-entry table doesn't map to 0; bytes hash as the table maps them.
The hash of a word is a polynomial in an odd base modulo 2**64, so it is had from running sums and the base's inverse, then mixed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; a longer text is handled alone.
SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1

#: ASCII white space separates; all else is kept as it is.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[9, 10, 11, 12, 13, 32]] = 0
PLAIN[0] = 1
#: The same with ASCII letters folded to lower case.
FOLDED = PLAIN.copy()
FOLDED[65:91] += 32
#: ASCII letters and digits, folded, and all bytes of other characters; the rest separates.
ALNUM = np.zeros(256, np.uint8)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_lo:_hi] = FOLDED[_lo:_hi]

_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers["up"]) < n:
        n = 1 << (n - 1).bit_length()
        for key, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            full = np.full(n, U(base))
            full[0] = 1
            _powers[key] = np.cumprod(full, dtype=U)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's last steps."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of parts of about SLICE bytes; null is as empty."""
    texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else texts.combine_chunks().cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + SLICE, "right")) - 1)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte of each word, first word of each row and the end)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z, np.zeros(len(off), np.int64)
    mapped = table[data]
    inside = mapped != 0
    edge = np.zeros(n + 1, bool)
    edge[off] = True  # a word doesn't go on into the next row
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum(mapped * up[:n], dtype=U, out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))
    return h, starts, ends, np.searchsorted(starts, off)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 have none."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * U(BASE) + h[j : j + n]
    return mix(out)


def run_hashes(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each index of `at` on, for a k of any size: from running sums."""
    up, down = powers(len(h))
    total = np.append(np.zeros(1, U), np.cumsum(h * up[: len(h)], dtype=U))
    return mix((total[at + k] - total[at]) * down[at])


def gram_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of each k-gram that lies within one row, its row); first: as words() gives it."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - begin[rows] + first[:-1][rows], rows


def least_of(h: np.ndarray, rows: np.ndarray, w: int) -> np.ndarray:
    """For each index that of the least hash among it and the w - 1 after it, as far as its row goes; of equal ones the last.

    h: hashes in order, rows: their rows, not decreasing."""
    n = len(h)
    best = np.arange(n)
    value = h.copy()
    span = 1
    while span < w:  # doubling: best of the `span` hashes from each on
        step = min(span, w - span)
        left, right = value[:-step], value[step:]
        better = np.zeros(n, bool)
        better[:-step] = (right <= left) & (rows[step:] == rows[:-step])
        at = np.flatnonzero(better)
        new_value, new_best = value.copy(), best.copy()
        new_value[at], new_best[at] = value[at + step], best[at + step]
        value, best = new_value, new_best
        span += step
    return best


def winnow(h: np.ndarray, rows: np.ndarray, w: int) -> np.ndarray:
    """Indices that winnowing keeps: of each w neighbours in a row what least_of() says. A row of fewer than w hashes keeps its least."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    best = least_of(h, rows, w)
    count = np.bincount(rows, minlength=int(rows[-1]) + 1)
    start = np.cumsum(count) - count
    full = np.arange(n) - start[rows] <= np.maximum(count[rows] - w, 0)
    keep = np.zeros(n, bool)
    keep[best[full]] = True
    return np.flatnonzero(keep)
