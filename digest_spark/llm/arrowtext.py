"""Byte-level views of Arrow text columns, shared by the operators that scan whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The ASCII white space of the contracts.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

OTHER, SPACE, LETTER, DIGIT, PUNCT, HIGH = range(6)


def byte_classes() -> np.ndarray:
    """Class of each of the 256 byte values."""
    out = np.full(256, OTHER, np.uint8)
    out[33:127] = PUNCT
    out[list(SPACE_BYTES)] = SPACE
    out[48:58] = DIGIT
    out[65:91] = LETTER
    out[97:123] = LETTER
    out[128:] = HIGH
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the len+1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices that hold about `most` bytes of text at most (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start, done = 0, 0
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def pieces(data: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries of the pieces of every row, and for each row the index of its first piece.

    cut[256 * a + b] says that the text is cut between neighbouring bytes a and b. Rows are cut
    from each other anyway. The first array has one entry more than there are pieces.
    """
    n = len(data)
    at = np.zeros(n + 1, bool)
    if n > 1:
        pair = data[:-1].astype(np.uint16)
        pair <<= 8
        pair |= data[1:]
        at[1:n] = cut[pair]
    at[offsets] = True
    at[n] = True
    bounds = np.flatnonzero(at)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    return bounds, np.searchsorted(bounds, offsets)


def as_binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The pieces as an Arrow array that shares the bytes."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)]
    )


def values(array: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls."""
    data, offsets = column_bytes(array)
    raw, at = data.tobytes(), offsets.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
