"""Vectorised words, word hashes and window hashes over Arrow string columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text, which is the same as the pattern
``[^\\x20\\x09-\\x0D]+`` on characters. Hashes are polynomial (Rabin-Karp) modulo 2^64 over random byte values and are
finished by a mixing step; they are the same in every process. All functions work on whole texts; ``chunks`` only
bounds how many documents are held as numpy arrays at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher (splitmix64's constants)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE, _STEP = 0x5851F42D4C957F2D, 0xD1342543DE82EF95
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = mix(np.arange(1, 257, dtype=U))
_LOWER = _VALUE.copy()
_LOWER[65:91] = _VALUE[97:123]


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < 2^bits."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(1 << bits, b, dtype=U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, max(16, int(n).bit_length()))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes of text; nulls have no bytes."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """Words of consecutive documents: byte spans, hashes, and the index of each document's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(data)
        space = _SPACE[data]
        edge = np.ones(n + 1, dtype=bool)  # a word can't reach over the edge before byte i
        edge[1:n] = space[:-1] if n else False
        edge[offsets] = True
        if n:
            edge[:n] |= space
        solid = ~space
        self.start = np.flatnonzero(solid & edge[:n])
        self.end = np.flatnonzero(solid & edge[1:]) + 1
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        p, q = powers(_BASE, n + 1)
        total = np.zeros(n + 1, dtype=U)
        np.cumsum((_LOWER if lower else _VALUE)[data] * p[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * q[self.start] + (self.end - self.start).astype(U))
        self._rolled: np.ndarray | None = None

    def windows(self, k: int, hashes: np.ndarray | None = None) -> np.ndarray:
        """The Rabin-Karp hash of each k words from word i on, documents' ends ignored; n - k + 1 values at most."""
        h = self.hash if hashes is None else hashes
        n = len(h)
        if n < k:
            return np.zeros(0, dtype=U)
        p, q = powers(_STEP, n + 1)
        if hashes is not None or self._rolled is None:
            total = np.zeros(n + 1, dtype=U)
            np.cumsum(h * p[:n], out=total[1:])
            if hashes is None:
                self._rolled = total
        else:
            total = self._rolled
        return mix((total[k:] - total[:-k]) * q[: n - k + 1] + U(k))
