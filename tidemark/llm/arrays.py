"""Words and word sequences of Arrow text columns as numpy arrays.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR.  A word is named by a
64-bit hash of its bytes, a sequence of words by a 64-bit hash built by doubling (1, 2, 4, ... words).
Two differently seeded hashes of a sequence are independent, so callers that route by one and compare
by the other tell sequences apart by more than 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 3
_MASK = (1 << 64) - 1
_SEGMENT = 1 << 18


def _spread(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values (splitmix64)."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed * 1_000_003)) * _U(_BASE))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_CODES = _spread(256, 1)
_FOLDED = _CODES.copy()
_FOLDED[65:91] = _CODES[97:123]
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size, out = max(n, _SEGMENT), []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        table = np.empty(size, dtype=_U)
        table[0], done, step = 1, 1, base
        while done < size:
            take = min(done, size - done)
            table[done : done + take] = table[:take] * _U(step)
            done, step = done + take, step * step & _MASK
        out.append(table)
    if size <= 4 * _SEGMENT:
        _powers[:] = out
    return out[0], out[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the n + 1 offsets of its rows in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def split_words(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row (and the end) the number of words before it."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(rows), np.int64)
    word = ~SPACES[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[rows[:-1][rows[:-1] < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    after = before
    after[-1], after[:-1] = False, word[1:]
    after[rows[1:][rows[1:] > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, rows)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; fold: A-Z count as a-z.  Memory is bounded by segments, or one word."""
    codes, out, i, n = _FOLDED if fold else _CODES, np.empty(len(starts), dtype=_U), 0, len(starts)
    while i < n:
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _SEGMENT, side="right")))
        span = int(ends[j - 1] - base)
        power, inverse = _power_tables(span)
        sums = np.empty(span + 1, dtype=_U)
        sums[0] = 0
        np.cumsum(codes[data[base : base + span]] * power[:span], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))
        i = j
    return out


def hash_runs(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of each run of k consecutive words (len(words) - k + 1 of them)."""
    if len(words) < k:
        return np.empty(0, dtype=_U)
    left, right = (_U(x) for x in (_spread(2, 100 + seed) | _U(1)))
    have, width, rest = None, 0, k
    power, size = mix(words + left), 1
    while True:
        if rest & 1:
            have, width = (power, size) if have is None else (mix(have[: len(power) - width] * left + power[width:] * right) if len(have) >= len(power) else mix(have[: len(power) - width] * left + power[width : width + len(have)] * right), width + size)
        rest >>= 1
        if not rest:
            return have[: len(words) - k + 1]
        power, size = mix(power[:-size] * left + power[size:] * right), 2 * size


def hash_rows(words: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each row's whole word sequence (first: word offsets of the rows, as from split_words)."""
    at = np.arange(len(words), dtype=_U) - np.repeat(first[:-1], np.diff(first)).astype(_U)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(words + mix(at + _U(7919 * (seed + 1)))))])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(_U) * _U(0xA0761D6478BD642F))


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """A bucket from 0 to n - 1 by the upper half of each hash."""
    return (((hashes >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)


def grouped(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of keys 0..n-1 and the n + 1 bounds of each key's items in it."""
    small = np.uint16 if n <= 1 << 16 else np.int64
    return np.argsort(keys.astype(small), kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=n))])


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(ordered):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def pack_positions(x: np.ndarray) -> bytes:
    """Small non-negative integers: 2 bytes each if all fit, else 4 or 8, after one byte that tells."""
    top = int(x.max()) if len(x) else 0
    kind = np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def unpack_positions(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype={2: np.uint16, 4: np.uint32, 8: np.uint64}[raw[0]], offset=1).astype(np.int64)


def trim() -> None:
    """Give memory that is free again back to the system: workers of one machine share little of it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass
