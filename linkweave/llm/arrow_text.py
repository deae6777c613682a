"""Views of Arrow string columns as NumPy bytes, for operators that scan whole texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Lower-cases A-Z only; every other byte stays.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
LOWER_BYTES = LOWER.tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(data, offsets)`` of a string column; a null is an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def blocks(column: pa.Array, limit: int = 1 << 20, most_rows: int = 1 << 14) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` over whole rows, about ``limit`` bytes and at most ``most_rows`` rows each.

    A longer text is a block of its own, so memory follows the longest text and not the batch.
    """
    data, offsets = buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, row + most_rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def texts(column: pa.Array) -> Iterator[bytes]:
    """Each text's UTF-8 bytes, without a copy of the whole batch; a null is empty."""
    data, offsets = buffers(column)
    view = memoryview(data)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield view[start:end].tobytes()


def _libc_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


_TRIM = _libc_trim()


def give_back() -> None:
    """Return what a task has freed to the system, so that a worker which lives on doesn't hold it through later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
