"""Words of whole Arrow text batches as numpy arrays, without a Python step per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer single text is handled whole.
SLICE_BYTES = 1 << 20
NOT_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: ASCII letters and all bytes of other characters.
LETTERS = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def _byte_values() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that their order is as good as random."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & ((1 << 64) - 1), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, offsets from 0, bytes) for slices of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, offsets[start:stop + 1] - offsets[start], data[offsets[start]:offsets[stop]]
        start = stop


PACKED = "doc_id long, size long, packed binary"


def pack(batches):
    """(doc_id, text) as (doc_id, size, packed): texts as zstd bytes, under half of what a shuffle takes."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            texts = [(t or "").encode() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([pa.compress(t, codec="zstd", asbytes=True) if t else b"" for t in texts], pa.binary())],
                names=["doc_id", "size", "packed"])


def unpack(sizes, packed) -> list[bytes]:
    return [pa.decompress(p, n, codec="zstd", asbytes=True) if n else b"" for n, p in zip(sizes, packed)]


class Words:
    """Words of consecutive texts: byte starts and ends, and the first word of each text.

    Words are runs of bytes other than space and \\x09-\\x0D, or of the bytes that
    ``member`` (256 booleans) names.  ``first`` has one entry more than there are texts.
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray, member: np.ndarray = NOT_SPACE):
        self.data = data
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = member[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge))
        self.ends = np.flatnonzero(before & (~inside | edge))
        self.first = np.searchsorted(self.starts, offsets, side="left")

    def hashes(self, lower: bool = False, bytes_: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes, or its first ``bytes_`` (``lower``: A-Z as a-z)."""
        values = _byte_values()
        if lower:
            values[65:91] = values[97:123]
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(values[self.data] * powers(_ODD, len(self.data)), out=total[1:])
        back = powers(_INVERSE, len(self.data) + 1)[self.starts]
        ends = self.ends if bytes_ is None else np.minimum(self.ends, self.starts + bytes_)
        return mix((total[ends] - total[self.starts]) * back + (ends - self.starts).astype(np.uint64))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words starting at each word; windows may run across texts, mask them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_ODD, len(words)), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(_INVERSE, n))


def windows_inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Whether the ``k`` words from each of ``n`` starts lie in one text."""
    text_end = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= text_end
