"""Vectorised word and shingle hashing over Arrow batches of UTF-8 bytes (helpers that run inside tasks)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; bounds the temporary arrays whatever a batch holds.
SLICE_BYTES = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_POW = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
_STEP = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


#: What empties the caches that operators keep in a worker from task to task.
CACHES: list = []


def release(caches: bool = False, but=None) -> None:
    """Give freed memory back, for the JVM and the other workers beside this one. ``caches``: and what earlier operators have
    kept, ``but`` for one of CACHES; asked for by tasks that begin with work of another kind."""
    if caches:
        for empty in CACHES:
            if empty is not but:
                empty()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    h = h ^ (h >> np.uint64(30))  # a new array, so the rest can be in place
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def mix_into(h: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """``mix`` in place of ``h``; ``spare`` is an array like it to work in."""
    np.right_shift(h, np.uint64(30), out=spare)
    h ^= spare
    h *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(h, np.uint64(27), out=spare)
    h ^= spare
    h *= np.uint64(0x94D049BB133111EB)
    np.right_shift(h, np.uint64(31), out=spare)
    h ^= spare
    return h


def _powers(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = np.cumprod(np.full(1 << n.bit_length(), 0x9E3779B97F4A7C15, np.uint64))
    return _POW


class Words(NamedTuple):
    """Words of rows ``first`` to ``last`` - 1; row r owns words ``at[r - first]`` to ``at[r - first + 1]``."""

    first: int
    last: int
    at: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray  # byte offsets into ``data``
    ends: np.ndarray
    data: np.ndarray  # uint8 view of the rows' bytes
    row_at: np.ndarray  # byte offsets of the rows in ``data``


def _segment(data: np.ndarray, breaks: np.ndarray, lower: bool, separator: np.ndarray):
    """starts, ends and hashes of the words of ``data``; a word never crosses a break."""
    word = ~separator[data]
    if not word.any():
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    before = np.empty(len(word), bool)
    before[0] = False
    before[1:] = word[:-1]
    before[breaks[breaks < len(word)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(len(word), bool)
    after[-1] = False
    after[:-1] = word[1:]
    inner = breaks[(breaks > 0) & (breaks < len(word))] - 1
    after[inner] = False
    ends = np.flatnonzero(word & ~after) + 1
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(first, lens)
    power = _powers(int(lens.max()))
    hashes = np.add.reduceat((_LOWER_BYTE if lower else _BYTE)[data[word]] * power[place], first)
    return starts, ends, mix(hashes)


def hash_words(data: np.ndarray, breaks: np.ndarray, lower: bool, separator: np.ndarray = _WHITE):
    """As ``_segment``, in slices cut at separators, so that one very long text needs little more than its words."""
    if len(data) <= 2 * SLICE_BYTES:
        return _segment(data, breaks, lower, separator)
    out, lo = [], 0
    while lo < len(data):
        hi = min(len(data), lo + SLICE_BYTES)
        if hi < len(data):
            gap = np.flatnonzero(separator[data[hi : hi + SLICE_BYTES]])
            hi = hi + int(gap[0]) if len(gap) else min(len(data), hi + SLICE_BYTES) if len(data) - hi <= SLICE_BYTES else len(data)
        cut = breaks[(breaks >= lo) & (breaks < hi)] - lo
        s, e, h = _segment(data[lo:hi], cut, lower, separator)
        out.append((s + lo, e + lo, h))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out))


def batch_words(column: pa.Array, lower: bool = False, separator: np.ndarray = _WHITE) -> Iterator[Words]:
    """Words of every row of a binary column, some rows at a time. A null has no words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(buffers[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    null = column.is_null().to_numpy(zero_copy_only=False)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        end = min(n, max(row + 1, end))
        part = data[offsets[row] : offsets[end]]
        row_at = offsets[row : end + 1] - offsets[row]
        if null[row:end].any():  # bytes under a null do not count
            part = part.copy()
            for k in np.flatnonzero(null[row:end]):
                part[row_at[k] : row_at[k + 1]] = 32
        starts, ends, hashes = hash_words(part, row_at[:-1], lower, separator)
        at = np.searchsorted(starts, row_at)
        yield Words(row, end, at, hashes, starts, ends, part, row_at)
        row = end


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; a shorter, non-empty text is one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = hashes[: n - k + 1] * _STEP[0]
    for j in range(1, k):
        out = out + hashes[j : n - k + 1 + j] * _STEP[j]
    return mix(out + np.uint64(k))


def distinct_shingles(words: Words, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    for r in range(words.last - words.first):
        h = shingle_hashes(words.hashes[words.at[r] : words.at[r + 1]], k)
        yield words.first + r, np.unique(h) if len(h) > 1 else h


def signature(hashes: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that stand for a set of hashes."""
    with np.errstate(over="ignore"):
        a = int(np.add.reduce(mix(hashes + np.uint64(0x632BE59BD9B4E019))))
        b = int(np.add.reduce(mix(hashes ^ np.uint64(0xA0761D6478BD642F))))
    return signed(a), signed(b)


def signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x
