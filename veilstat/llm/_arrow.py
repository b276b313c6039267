"""Helpers for Arrow batches: byte views of string columns, bounded slices of rows, models by broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

# In workers, freed batches go back to the system at once: they live from stage to stage and share an executor's memory.
if TaskContext.get() is not None:
    pa.set_memory_pool(pa.system_memory_pool())


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (nulls empty) as one array, and the offsets of the rows in it."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of at most `limit` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive offsets along axis 0; empty rows give 0."""
    starts, ends = offsets[:-1], offsets[1:]
    small = values.dtype.kind in "biu" and values.dtype != np.uint64  # 64-bit words wrap around
    out = np.zeros((len(starts), *values.shape[1:]), np.int64 if small else values.dtype)
    full = np.flatnonzero(ends > starts)
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], axis=0, dtype=out.dtype)
    return out
