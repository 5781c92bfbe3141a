"""Vectorised work on Arrow text columns: words ``[^\\x20\\x09-\\x0D]+`` and their hashes, without a loop over rows."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_STEP = 0x9E3779B97F4A7C15
_caches: dict[str, tuple[dict, ...]] = {}
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Words(NamedTuple):
    """Words of the rows of one chunk: byte offsets into ``data``, and for row r the words bounds[r]:bounds[r + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and those of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows in a row, and len + 1 offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(data: np.ndarray, off: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes (or one row), each with its own bytes and offsets."""
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray) -> Words:
    n = len(data)
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    at = off[:-1][off[:-1] < n]
    first[at] = solid[at]
    at = off[1:][off[1:] > 0] - 1
    last[at] = solid[at]
    start = np.flatnonzero(first)
    return Words(data, start, np.flatnonzero(last) + 1, np.searchsorted(start, off))


def word_hashes(w: Words) -> np.ndarray:
    """64-bit hashes of words by a polynomial over their bytes, from one prefix sum."""
    n = len(w.data)
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((w.data + np.uint64(1)) * up[:n], out=prefix[1:])
    h = (prefix[w.end] - prefix[w.start]) * down[w.start]
    return mix(h + (w.end - w.start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def roll(h: np.ndarray, n: int, factor: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    """Hash of every n consecutive values; neighbours of other rows are mixed in, the caller masks them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have, part, size, power = None, 0, h, 1, factor
    todo = n
    while todo:
        if todo & 1:
            out = part if out is None else out[: len(part[have:])] * np.uint64(power) + part[have:][: len(out)]
            have += size
        todo >>= 1
        if todo:
            part = part[:-size] * np.uint64(power) + part[size:]
            size, power = 2 * size, power * power % (1 << 64)
    return out[: len(h) - n + 1]


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype(np.int64, copy=False)).view(np.uint64)


def claim(owner: str, *caches: dict) -> None:
    """Names the memories that ``owner`` keeps in this process and empties those of all others: a reused worker serves one operator at a time.

    What the others held goes back to the system, as all workers of a machine share its memory.
    """
    gone = [name for name in _caches if name != owner]
    for name in gone:
        for c in _caches.pop(name):
            c.clear()
    _caches[owner] = caches
    if gone:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)
