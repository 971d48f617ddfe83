"""Vectorised text primitives over Arrow string buffers, shared by the corpus operators.

Texts are handled in chunks of a bounded number of bytes (a longer single text is a
chunk of its own), so that a Python worker's memory follows the chunk and the longest
text, not the batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 400_000
#: Chunks whose signatures are packed together: larger ones make fewer rows.
SIGNED_BYTES = 1_000_000
U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix64(x + U64(seed * _ODD & _MASK))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 15):
    """Slices of a batch whose texts hold at most `limit` bytes, with one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + limit, side="right"))
        stop = min(max(stop, start + 1), n, start + rows)
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and each row's offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true cells that don't cross a row: starts, ends, and each row's number of runs."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    left = np.empty(n, bool)
    left[0] = False
    left[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~left | first[:-1]))
    right = np.empty(n, bool)
    right[-1] = False
    right[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~right | first[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


#: Spans of more bytes are hashed one by one with BLAKE2b.
LONG = 256
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [_MASK], np.uint64)


class SpanHasher:
    """Hashes of spans of a byte array, eight bytes at a time.

    Each step mixes the next eight bytes into the state with a bijection of 64 bits, so
    that spans of at most eight bytes and equal length never collide and longer ones do so
    by chance only, with 2^-64 for a pair; spans beyond LONG bytes get a keyed BLAKE2b.
    Hashes of different seeds are independent of each other.
    """

    def __init__(self, data: np.ndarray):
        self.data = np.zeros(len(data) + 8, np.uint8)
        self.data[: len(data)] = data
        self.cells = np.ndarray((len(data) + 1,), "<u8", self.data.data, strides=(1,))

    def _word(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return self.cells[at] & _TAIL[np.minimum(left, 8)]

    def __call__(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        starts, size = np.asarray(starts, np.int64), np.asarray(ends, np.int64) - starts
        h = seeded(size.astype(np.uint64), 2 * seed + 1)
        live = np.flatnonzero((size > 0) & (size <= LONG))
        done = 0
        while len(live):
            h[live] = mix64(h[live] ^ self._word(starts[live] + done, size[live] - done))
            done += 8
            live = live[size[live] > done]
        key = seed.to_bytes(8, "little")
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[starts[i] : starts[i] + size[i]], digest_size=8, key=key).digest(), "little")
        return h

    def digests(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """128 bits of BLAKE2b of each span, a row of 16 bytes each: for keys that stand for the bytes themselves."""
        out = b"".join([hashlib.blake2b(self.data[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        return np.frombuffer(out, np.uint8).reshape(-1, 16)

    def equal(self, starts: np.ndarray, others: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes at `starts` are those at `others`, byte by byte."""
        same = np.ones(len(starts), bool)
        live = np.flatnonzero((size > 0) & (size <= LONG) & (starts != others))
        done = 0
        while len(live):
            left = size[live] - done
            same[live] &= self._word(starts[live] + done, left) == self._word(others[live] + done, left)
            done += 8
            live = live[size[live] > done]
        for i in np.flatnonzero((size > LONG) & (starts != others)).tolist():
            same[i] = np.array_equal(self.data[starts[i] : starts[i] + size[i]], self.data[others[i] : others[i] + size[i]])
        return same


#: Bytes of a word [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True


def word_hashes(column: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of ASCII-lower-cased texts, and each row's number of words."""
    data, offsets = utf8(column)
    data = lower_ascii(data)
    starts, ends, counts = runs(inside[data], offsets)
    return SpanHasher(data)(starts, ends), counts


def codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a string column end to end, and each row's offsets."""
    data, offsets = utf8(column)
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    cells = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return cells, lead[offsets]


def row_of(counts: np.ndarray) -> np.ndarray:
    """The row of each of the cells that `counts` deals to rows."""
    return np.repeat(np.arange(len(counts)), counts)


def starts_of(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def segment_sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values[starts[i]:starts[i + 1]]; empty stretches give 0. Wraps for uint64."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def binary(parts) -> pa.Array:
    return pa.array([None if x is None else x.tobytes() for x in parts], pa.binary())
