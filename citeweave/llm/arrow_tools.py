"""Helpers for Arrow-batched operators: slices of bounded size, and binary columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def bounded_slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose ``column`` holds at most ``max_bytes`` (or one longer row).

    Nothing is dropped; a row longer than the bound is a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, before + max_bytes, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
        pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings; null becomes the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def utf8_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null becomes empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
