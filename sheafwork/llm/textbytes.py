"""Vectorised word, line and shingle arithmetic over the UTF-8 bytes of an Arrow batch.

Everything works on blocks of whole rows of at most ``BLOCK`` bytes (one longer row
is a block of its own), so memory is bounded by the longest single text.
Words and shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_POWER = _rng.integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Block:
    """Rows ``first`` to ``first + n`` of a batch: their bytes and the bounds of each."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds, self.n = first, data, bounds, len(bounds) - 1


def blocks(column: pa.Array) -> Iterator[Block]:
    """The texts of an Arrow string column in bounded blocks; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK, "right")) - 1)
        yield Block(i, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        i = j


class Words:
    """Words of a block: start, stop (bytes), row, and hash of each."""

    def __init__(self, block: Block, lower: bool = False):
        data = LOWER[block.data] if lower else block.data
        solid = ~SPACE[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        edges = block.bounds[:-1][np.diff(block.bounds) > 0]
        begins[edges] = solid[edges]
        self.start = np.flatnonzero(begins)
        self.row = np.searchsorted(block.bounds, self.start, "right") - 1
        self.n = len(self.start)
        place = np.flatnonzero(solid)
        if self.n == 0:
            self.stop, self.hash = self.start, np.zeros(0, np.uint64)
            return
        first = np.searchsorted(place, self.start)
        size = np.diff(np.append(first, len(place)))
        self.stop = self.start + size
        at = np.arange(len(place)) - np.repeat(first, size)
        self.hash = mix(np.add.reduceat((data[place].astype(np.uint64) + _U(1)) * _POWER[at & 0xFFFF], first) + size.astype(np.uint64))

    def windows(self, k: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of k words within one row, or one group of words."""
        group = self.row if group is None else group
        if self.n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(self.n - k + 1, np.uint64)
        for j in range(k):
            total += self.hash[j : self.n - k + 1 + j] * _STEP[j]
        inside = np.flatnonzero(group[: self.n - k + 1] == group[k - 1 :])
        return inside, mix(total[inside])

    def repeated(self, k: int, group: np.ndarray | None = None) -> np.ndarray:
        """Marks the words that lie in a k-word window found twice or more in their row, or their group."""
        group = self.row if group is None else group
        marked = np.zeros(self.n, bool)
        at, h = self.windows(k, group)
        if len(at):
            key = mix(h + group[at].astype(np.uint64) * _STEP[40])
            order = np.sort(key)
            twice = np.unique(order[1:][order[1:] == order[:-1]])
            if len(twice):
                hit = at[np.isin(key, twice)]
                for j in range(k):
                    marked[hit + j] = True
        return marked


class Lines:
    """Lines of a block, split at line feeds; a row without one is one line, empty or not."""

    def __init__(self, block: Block):
        feeds = np.flatnonzero(block.data == 10)
        self.start = np.sort(np.concatenate([block.bounds[:-1], feeds + 1]), kind="stable")
        row = np.concatenate([np.arange(block.n), np.searchsorted(block.bounds, feeds, "right") - 1])
        self.row = np.sort(row, kind="stable")
        self.n = len(self.start)
        last = np.append(self.row[1:] != self.row[:-1], True)
        self.stop = np.append(self.start[1:] - 1, 0)
        self.stop[last] = block.bounds[1:][self.row[last]]

    def count(self, mask_sum: np.ndarray) -> np.ndarray:
        """Per line, from a running sum over bytes (one longer than the bytes)."""
        return mask_sum[self.stop] - mask_sum[self.start]


def running(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def per(index: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(index, weight, n) if weight is not None else np.bincount(index, minlength=n)


def span_hash(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each of several disjoint byte spans in order; an empty span hashes to mix(0)."""
    size = stop - start
    out = np.zeros(len(start), np.uint64)
    full = np.flatnonzero(size > 0)
    if len(full):
        n = size[full]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(first, n)
        place = within + np.repeat(start[full], n)
        out[full] = np.add.reduceat((data[place].astype(np.uint64) + np.uint64(1)) * _POWER[within & 0xFFFF], first) + n.astype(np.uint64)
    return mix(out)
