"""Vectorised reading of Arrow text columns: bytes, words, lines and hashes of many documents at once.

Documents are handled in blocks of about ``BLOCK`` bytes (a longer document is a block of its own),
so memory depends on the block and on the longest document, not on the Arrow batch.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
#: The space characters of ``[\x20\x09-\x0D]``.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit integers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _PRIME + np.uint64(seed))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def spans(off: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``limit`` bytes together, or one longer document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def per_doc(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many True of ``mask`` each document has."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


#: Masks of the first 0 to 8 bytes of eight.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer ranges are hashed one by one by a library function, shorter ones together, 8 bytes a step.
_LONG = 256


class Hasher:
    """64-bit hashes of any byte ranges of a block. Each 8 bytes are mixed into the hash of those before, so no
    structure of the bytes (unlike with a polynomial) makes two ranges collide but chance."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.padded = np.concatenate((data, np.zeros(8, np.uint8)))
        self.eight = np.ndarray((len(data) + 1,), "<u8", buffer=self.padded, strides=(1,))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = mix(size.astype(np.uint64) * _PRIME + np.uint64(11))
        at = np.flatnonzero((size > 0) & (size <= _LONG))
        place, left = start[at], size[at]
        while len(at):
            out[at] = mix(out[at] ^ ((self.eight[place] & KEEP[np.minimum(left, 8)]) + _PRIME))
            more = left > 8
            at, place, left = at[more], place[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > _LONG):
            out[i] = int.from_bytes(hashlib.blake2b(self.data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        return out


def ranges(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that don't cross documents: starts, ends, document of each."""
    n = len(inside)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first = inside & (cut[:n] | np.concatenate(([True], ~inside[:-1])))
    last = inside & (cut[1:] | np.concatenate((~inside[1:], [True])))
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def windows(hashes: np.ndarray, doc: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first item, hash) of each run of ``width`` items within a document."""
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(hashes) - width + 1
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    factor = stream(seed, width) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += hashes[k : k + n] * factor[k]
    return at, mix(out[at])


def tidy(run: Callable) -> Callable:
    """``run``, a function for mapInArrow, that gives its free memory back to the system when a task ends, as
    Spark's Python workers live on."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole
