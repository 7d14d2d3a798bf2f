"""Arrow batches of texts in parts of bounded size, and memory given back between them."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART = 4 << 20  # bytes of text that are Python objects at once


def parts(texts: pa.Array, limit: int = PART) -> Iterator[slice]:
    """Consecutive ranges of rows with at most about ``limit`` bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield slice(start, stop)
        start = stop


def strings(texts: pa.Array, rows: slice) -> list[str]:
    """The texts of a range of rows; null gives an empty one."""
    return [t or "" for t in texts[rows].to_pylist()]


def release() -> None:
    """Gives freed memory back to the system: Python workers live on between stages, and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
