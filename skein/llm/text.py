"""Vectorised views of whole texts: byte buffers, word spans and 64-bit rolling hashes.

Every function works on the UTF-8 buffer of an Arrow string column, so a batch of texts is
handled in a few numpy passes. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are unfolded into numpy arrays at once; one longer text makes its own block.
BLOCK = 1 << 20

_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Words `[^\x20\x09-\x0D]+`.
NON_SPACE = ~_SPACE
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; sizes are rounded up so that few are kept."""
    return _powers(base, max(1 << 12, 1 << int(n - 1).bit_length()))[:n] if n <= 4 * BLOCK else np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, np.uint64(base))])


class Rolling:
    """Hashes of any slice of a byte buffer after one pass over it."""

    def __init__(self, buf: np.ndarray):
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * powers(_MUL, max(1, len(buf)))[: len(buf)], out=self.sums[1:])
        self.inverse = powers(_INV, len(buf) + 1)

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and int64 offsets of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    off = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows [lo, hi) of about `limit` bytes with their own buffer and offsets."""
    buf, off = strings(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the runs of True that do not cross a row's end."""
    n = len(inside)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    cut = off[(off > 0) & (off < n)]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[cut] = inside[cut]
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(off, starts, "right") - 1


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive word hashes and the index of each one's first word, within rows."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[:m].copy()
    for k in range(1, n):
        out *= np.uint64(_MUL)
        out += h[k : k + m]
    at = np.flatnonzero(row[:m] == row[n - 1 : n - 1 + m])
    return mix(out[at]), at
