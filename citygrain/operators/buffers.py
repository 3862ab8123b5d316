"""Numpy views of Arrow string buffers, shared by the kernels that work on bytes instead of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled by one kernel pass; a longer single text is a pass of its own, never cut.
PASS_BYTES = 1 << 20


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def passes(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about PASS_BYTES of text each, at least one row a range."""
    _, offsets = string_bytes(column)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + PASS_BYTES, "right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, stop
        start = stop


def slices(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """String array of data[start:stop] per entry, taken with one gather."""
    size = stop - start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    index = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[index]))).cast(pa.string()) if offsets[-1] < 2**31 else pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[index])))


def codes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Up to eight bytes of each slice packed in an unsigned integer; 0 for longer or empty slices."""
    size = stop - start
    out = np.zeros(len(size), np.uint64)
    for k in range(8):
        has = (size > k) & (size <= 8)
        out[has] |= data[start[has] + k].astype(np.uint64) << np.uint64(8 * k)
    return out


def code(word: str) -> np.uint64:
    """The value that ``codes`` gives for ``word`` of at most eight bytes."""
    return np.uint64(int.from_bytes(word.encode(), "little"))


def last_index(mask: np.ndarray) -> np.ndarray:
    """At each place the last index at or before it where ``mask`` holds, else -1."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))


def next_index(mask: np.ndarray) -> np.ndarray:
    """At each place the first index at or after it where ``mask`` holds, else the length."""
    n = len(mask)
    return np.minimum.accumulate(np.where(mask, np.arange(n), n)[::-1])[::-1]
