"""Vectorised helpers over Arrow string columns: bytes, words and rolling hashes. Run inside tasks only."""

from __future__ import annotations

from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
#: An odd factor for polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
_INV = pow(BASE, -1, 1 << 64)
#: Bytes that are handled at a time: bounds the memory of the 64-bit arrays.
CHUNK = 1 << 20


def texts(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values one after another, and the n + 1 offsets. Null is empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kind = pa.large_binary()
    a = a.cast(pa.large_string()).fill_null("").cast(kind) if pa.types.is_string(a.type) or pa.types.is_large_string(a.type) else a.cast(kind).fill_null(b"")
    _, offs, data = a.buffers()
    offs = np.frombuffer(offs, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = CHUNK) -> list[tuple[int, int]]:
    """Ranges of rows with about limit bytes each; a longer text is a range of its own."""
    out, i, n = [], 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, U)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p, out=p) if n else p


_kept: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """The first n powers; those for usual lengths are kept."""
    if n > 4 * CHUNK:
        return _powers(n, base)
    if base not in _kept or len(_kept[base]) < n:
        _kept[base] = _powers(max(n, CHUNK + (CHUNK >> 2)), base)
    return _kept[base][:n]


@cache
def byte_values(lower: bool = False) -> np.ndarray:
    """A random number for each byte; with lower, A-Z count as a-z."""
    t = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
    if lower:
        t[65:91] = t[97:123]
    return t


class Rolling:
    """Polynomial hashes of any slices of some bytes, from one prefix sum."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        n = len(data)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(byte_values(lower)[data] * powers(n), out=self.sums[1:])
        self.back = powers(n + 1, _INV)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U) * U(BASE >> 7))

    def fixed(self, width: int) -> np.ndarray:
        """Of all slices of that many bytes."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.back[:n])


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in consecutive texts, and the number of each text's first word (n + 1 of them)."""
    inside = ~_SPACE[data]
    n = len(data)
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = offs[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


class Digests(dict):
    """64-bit BLAKE2b digests of words; at most `most` of them are kept in a worker."""

    def __init__(self, most: int = 1 << 17):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= self.most:
            self.clear()
        self[word] = h
        return h


_digests = Digests()


def word_digests(text: bytes) -> np.ndarray:
    """A digest of each word of a text, A-Z as a-z: bytes.lower() and bytes.split() know ASCII only, and split at the same six bytes as WORD."""
    w = text.lower().split()
    return np.fromiter(map(_digests.__getitem__, w), U, len(w))


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(word_hashes) - k + 1
    h = np.zeros(max(n, 0), U)
    for i in range(k):
        h = mix(h + word_hashes[i : i + max(n, 0)] * U(2 * i + 3))
    return h
