"""Vectorised text primitives over Arrow string buffers.

Hashes are polynomial over the UTF-8 bytes, modulo 2**64, so that the hash of any byte range follows from
two entries of one cumulative sum; a splitmix64 finaliser spreads them.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Fixed odd multiplier of the polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: ASCII letters fold to lower case; words are separated by space and the bytes 9 to 13.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser; x is not changed."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_values = mix(np.arange(1, 257, dtype=U))


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1), grown by doubling and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(size, U)
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * U(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have
    return have[:n]


def trim() -> None:
    """Hand freed memory of this Python worker back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _release() -> None:
    """Drop what encoders of an earlier stage have learned in this Python worker, and hand free memory back.

    Workers serve one stage after the other: what one left unused would add up with what the next one needs."""
    tokens = sys.modules.get(f"{__package__}.tokens")
    if tokens is not None and tokens._encoders:
        tokens._encoders.clear()
        gc.collect()
    trim()


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes; a longer row is a run of its own.

    A null is an empty text."""
    if not len(column):
        return
    _release()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free hash of each byte range."""
    n = len(data)
    if not n or not len(starts):
        return np.zeros(len(starts), U)
    total = np.zeros(n + 1, U)
    np.cumsum(_values[data] * powers(n), out=total[1:])
    raw = (total[ends] - total[starts]) * powers(n + 1, INVERSE)[starts]
    return mix(raw + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash) of the words of each row, ASCII letters folded."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, U)
    low = LOWER[data]
    inside = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows, range_hash(low, starts, ends)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row its distinct word shingles as sorted hashes: ``width`` words, or all words where there are fewer."""
    _, _, rows, hashes = words(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(rows, minlength=n)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    keys = mix(np.arange(1, width + 1, dtype=U)) | U(1)
    size = max(0, len(hashes) - width + 1)
    rolled = np.zeros(size, U)
    for j in range(width):
        rolled += hashes[j : j + size] * keys[j]
    rolled = mix(rolled)
    out = []
    for i in range(n):
        a, b = at[i], at[i + 1]
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = mix((hashes[a:b] * keys[: b - a]).sum(dtype=U, keepdims=True) + U(b - a))
        else:
            s = np.zeros(0, U)
        out.append(s)
    return out
