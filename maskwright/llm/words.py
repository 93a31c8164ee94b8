"""Vectorised word spans over the UTF-8 bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z to a-z, all other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: bytes of words ``[^\x20\x09-\x0D]+``
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False

_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray, mul: np.uint64 = _MUL) -> np.ndarray:
    """Scramble 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(32))) * mul
    x = (x ^ (x >> np.uint64(29))) * _MUL2
    return x ^ (x >> np.uint64(32))


def slices(column: pa.Array, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of rows of about
    ``max_bytes``; nulls are empty. A longer text is a run of its own."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + max_bytes, side="right")) - 1)
        end = min(end, n)
        yield at, end, buf[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def spans(low: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of every row, and the index of each
    row's first word (one more entry for the end). Words end with their row."""
    inside = is_word[low]
    first, end = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offs[:-1] < offs[1:]
    heads, tails = offs[:-1][full], offs[1:][full] - 1
    first[heads] = inside[heads]
    end[tails] = inside[tails]
    s, e = np.flatnonzero(first), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def keys(low: np.ndarray, s: np.ndarray, e: np.ndarray, mul: np.uint64 = _MUL) -> np.ndarray:
    """A 64-bit key of each word: its own bytes up to 8 of them, else a hash."""
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    at = np.ndarray((len(low) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = e - s
    out = at[s] & _KEEP[np.minimum(size, 8)]
    longer, k = np.flatnonzero(size > 8), 8
    while longer.size:
        piece = at[s[longer] + k] & _KEEP[np.minimum(size[longer] - k, 8)]
        out[longer] = mix(out[longer] * _MUL2 + piece + np.uint64(k), mul)
        k += 8
        longer = longer[size[longer] > k]
    return out
