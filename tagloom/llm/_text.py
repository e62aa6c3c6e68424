"""Words and hashes of whole Arrow string columns, computed with numpy inside tasks.

A column's UTF-8 bytes are handled as one array, in slices of bounded size, so that no
Python object is made per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at once; numpy needs some fifty times this.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*excluded: tuple[int, int]) -> np.ndarray:
    """A table that is true for the bytes outside the given inclusive ranges."""
    table = np.ones(256, bool)
    for low, high in excluded:
        table[low : high + 1] = False
    return table


#: Bytes of words that white space separates.
PLAIN = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words of ASCII letters, digits and all non-ASCII characters.
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds some ``most`` bytes of ``column``, or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < len(sizes):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows together, and where each row starts and the last one ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32) if buffers[1] else np.zeros(1, np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes of ``table`` within a row."""
    inside = table[data]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    starts_of = offsets[:-1]
    before[starts_of[starts_of < len(data)]] = False
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    ends_of = offsets[1:]
    after[ends_of[ends_of > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


#: Longer ranges are hashed one by one.
_LONG = 64
#: What a range of eight bytes starts from.
_EIGHT = np.uint64(8 * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Hasher:
    """64-bit hashes of any byte ranges of ``data``; equal bytes have equal hashes.

    Blocks of eight bytes go through a scramble one after another, so no pattern in the bytes cancels out.
    Unequal ranges meet with a probability of some 2^-64 a pair; texts built against this very function could too.
    """

    def __init__(self, data: np.ndarray):
        padded = np.zeros(len(data) + 16, np.uint8)
        padded[8 : 8 + len(data)] = data
        self.data, self.blocks = data, np.ndarray((len(data) + 9,), "<u8", padded, 0, (1,))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size, at = ends - starts, starts + 8
        least, most = (int(size.min()), int(size.max())) if len(size) else (0, 0)
        first = self.blocks[at] if least >= 8 else self.blocks[at] & _MASKS[np.minimum(size, 8)]
        h = mix(first ^ (size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        if most > 8:
            left, k = np.flatnonzero((size > 16) & (size <= _LONG)) if most > 16 else size[:0], 8
            while len(left):
                h[left] = mix(h[left] + self.blocks[at[left] + k] * np.uint64(0x9FB21C651E98DF25))
                k += 8
                left = left[size[left] > k + 8]
            some = slice(None) if least > 8 else np.flatnonzero(size > 8)
            h[some] = mix(h[some] + self.blocks[ends[some]] * np.uint64(0xA0761D6478BD642F))
            long = np.flatnonzero(size > _LONG) if most > _LONG else size[:0]
            if len(long):
                view, digest = memoryview(np.ascontiguousarray(self.data)), hashlib.blake2b
                whole = [digest(view[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
                h[long] = np.frombuffer(b"".join(whole), np.uint64)
        return h

    def eights(self, n: int) -> np.ndarray:
        """The hashes, as the call gives them, of the eight bytes from each of the first ``n`` on; made in blocks that stay in the cache."""
        out = np.empty(n, np.uint64)
        for a in range(0, n, 1 << 14):
            out[a : a + (1 << 14)] = mix(self.blocks[8 + a : 8 + min(n, a + (1 << 14))] ^ _EIGHT)
        return out


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of ``size`` words within a row, and the runs' hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(rows[:n] == rows[size - 1 :])
    total = np.zeros(len(first), np.uint64)
    for k in range(size):
        total = total * np.uint64(_BASE) + hashes[first + k]
    return first, mix(total)


def sort_within(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``values`` sorted within each run of equal ``rows``."""
    values = values.copy()
    edges = np.append(np.flatnonzero(np.diff(rows, prepend=-1)), len(rows)).tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        values[a:b].sort()
    return values


def overlaps(of_a: np.ndarray, a: np.ndarray, of_b: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersection and of the union of the hash sets that ``a`` and ``b`` have in each of ``n`` rows; repeats count once."""
    # the row above, then as much of the hash as there is room for, and the side in the lowest bit: one sort of numbers
    room = np.uint64(64 - max(1, int(n).bit_length()))
    salted = (np.concatenate([of_a, of_b]).astype(np.uint64) << room) | (np.concatenate([a, b]) >> (np.uint64(64) - room))
    salted[: len(a)] &= ~np.uint64(1)
    salted[len(a) :] |= np.uint64(1)
    salted.sort()
    salted = salted[np.append(True, salted[1:] != salted[:-1])[: len(salted)]]
    of = (salted >> room).astype(np.int64)
    both = (salted[1:] ^ salted[:-1]) == np.uint64(1)
    common = np.bincount(of[1:][both], minlength=n)
    return common, np.bincount(of, minlength=n) - common


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the given ranges one after another, and the offsets of the ranges in them."""
    sizes = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])], offsets


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given byte ranges as an Arrow string column."""
    packed, offsets = gather(data, starts, ends)
    return pa.Array.from_buffers(pa.utf8(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(packed))])


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """``values`` as a list column whose rows have ``counts`` values each."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
