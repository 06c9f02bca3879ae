"""Arrow data in parts of a few MB, so that Python's memory follows neither the rows of a batch nor their lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that become Python objects at once, and what a row counts besides its text.
MOST, ROW = 2 << 20, 64


def lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of every text; a null has none."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def parts(sizes: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows (from, to) of about ``most`` bytes, one row at least; together they are all rows in order."""
    ends = np.cumsum(sizes + ROW)
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (most or MOST), side="right")))
        yield a, b
        a = b


def slices(batch: pa.RecordBatch, column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of a batch by the bytes of its binary or string ``column``."""
    for a, b in parts(lengths(batch.column(column)), most):
        yield batch.slice(a, b - a)
