"""Array views of Arrow string columns.

Python code that has to look inside texts does so over whole Arrow buffers: the
column's UTF-8 bytes and offsets are viewed as numpy arrays and every test is one
vectorised pass.  Nothing here loops over characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text viewed at once; the temporary arrays take about 60 times this.
CHUNK_BYTES = 1 << 20


@dataclass
class TextChunk:
    """Rows ``lo:hi`` of a column: their bytes joined, and where each row starts."""

    lo: int
    hi: int
    data: bytes
    offsets: np.ndarray  # int64, hi - lo + 1 byte positions into ``data``


def string_buffers(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes and the int64 offsets of a string column; a null has no bytes."""
    if pa.types.is_null(column.type):
        return memoryview(b""), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    view = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return memoryview(data) if data is not None else memoryview(b""), view


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[TextChunk]:
    """Consecutive rows holding at most ``limit`` bytes together, or one longer row."""
    data, offsets = string_buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield TextChunk(lo, hi, bytes(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def code_points(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points of UTF-8 ``data`` and the byte position of each (None: the same)."""
    if data.isascii():
        return np.frombuffer(data, np.uint8), None
    points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    return points, at


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    """A list column from numpy offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
