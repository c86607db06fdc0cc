"""Arrow batches in small pieces, so that what a Python worker holds of them as objects doesn't grow with what Spark sends at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows of a piece, and its bytes on average, at most.
ROWS, BYTES = 256, 1 << 20


def pieces[T: (pa.RecordBatch, pa.Array)](batch: T, rows: int = ROWS, size: int = BYTES) -> Iterator[T]:
    """The rows of a batch or an array in order, `rows` at a time, or fewer if these are more than `size` bytes on average; nothing is copied, and an empty one is one piece."""
    n = max(1, min(rows, len(batch) * size // max(1, batch.nbytes)))
    for at in range(0, max(1, len(batch)), n):
        yield batch.slice(at, n)
