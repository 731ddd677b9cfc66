"""Vectorised splitting and hashing of words over blocks of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that end words: white space alone, or all ASCII but letters and digits.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(i).isalnum() for i in range(128)]
BLOCK = 1 << 20


def _powers(n: int, base: np.uint64, held: dict = {}) -> np.ndarray:  # noqa: B006
    if base not in held or len(held[base]) < n:
        table = np.full(max(n, BLOCK + 1), base, np.uint64)
        table[0] = 1
        held[base] = np.cumprod(table, dtype=np.uint64)
    return held[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Some whole texts as bytes: raw, and off, where text i is raw[off[i]:off[i + 1]]."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.raw, self.off, self.n = raw, off, len(off) - 1
        self._sums = None

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Sums of flags, one a byte, by text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]

    def words(self, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the first word of each text (with one entry more)."""
        n = len(self.raw)
        word, edge = np.zeros(n + 2, bool), np.zeros(n + 1, bool)
        word[1:-1] = ~separators[self.raw]
        edge[self.off] = True
        starts = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
        ends = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.off)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of raw[start:end], A-Z lower-cased."""
        if self._sums is None:
            n = len(self.raw)
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[self.raw]] * _powers(n, _P), dtype=np.uint64)])
        return mix((self._sums[ends] - self._sums[starts]) * _powers(len(self.raw) + 1, _P_INV)[starts])


def blocks(column, size: int = BLOCK) -> Iterator[tuple[int, Block]]:
    """(index of the first text, Block) over an Arrow string column; null is empty. A block has over ``size`` bytes only if one text has."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(off, off[first] + size, "right")) - 1)
        yield first, Block(raw[off[first] : off[last]], off[first : last + 1] - off[first])
        first = last


def distinct(doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs in order: text, 44-bit hash, count. For blocks of fewer than 2**20 texts."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    if not len(key):
        return key.astype(np.int64), key, key.astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return (key[at] >> np.uint64(44)).astype(np.int64), key[at] & np.uint64((1 << 44) - 1), np.diff(np.concatenate([at, [len(key)]]))
