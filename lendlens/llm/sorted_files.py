"""Counts of 64-bit hashes: sorted, sent by ranges of the hash, kept in files that workers memory-map.

Tasks send their sorted distinct hashes with counts as one compressed row for each range, so a frequent hash is one
number for each task, and a range is even in size because hashes are.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from lendlens.llm.files import mapped, pack_numbers, unpack_numbers, write_whole

BLOBS = "range int, n long, data binary"
#: Hashes that a task keeps before it adds up equal ones.
ADD_UP = 4_000_000


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def bounds(ranges: int) -> np.ndarray:
    """The first hash of each range but the first."""
    return np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)


def blobs(keys: np.ndarray, counts: np.ndarray, ranges: int) -> pa.RecordBatch:
    cuts = [0, *np.searchsorted(keys, bounds(ranges)).tolist(), len(keys)]
    rows = [(i, b - a, pack_numbers(keys[a:b], counts[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    return blob_batch(rows)


def blob_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["range", "n", "data"]
    )


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sums of a range's blobs, taken in a few at a time."""
    keys, counts, size = [], [], 0
    for data in table.column("data"):
        k, c = unpack_numbers(data.as_py(), 2)
        keys.append(k)
        counts.append(c.astype(np.int64))
        size += len(k)
        if size > ADD_UP and len(keys) > 8:
            k, c = added(keys, counts)
            keys, counts, size = [k], [c], 0
    return added(keys, counts)


def sizes_of(rows: list, ranges: int) -> np.ndarray:
    """Of (range, size), the size of each range."""
    sizes = np.zeros(ranges, np.int64)
    for number, n in rows:
        sizes[number] = n
    return sizes


class SortedFiles:
    """Sorted hashes with counts, a file for each range of hashes, memory-mapped as they are needed.

    A file has the number of keys, the keys, their counts as one byte each, and the larger counts apart.
    """

    def __init__(self, folder: str, sizes: np.ndarray):
        self.folder, self.sizes = folder, sizes
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.bounds = bounds(len(sizes))

    def __getstate__(self):
        return {"folder": self.folder, "sizes": self.sizes}

    def __setstate__(self, state):
        self.__init__(**state)

    @staticmethod
    def write(folder: str, number: int, keys: np.ndarray, counts: np.ndarray) -> None:
        large = np.flatnonzero(counts >= 255)
        write_whole(
            f"{folder}/{number:08d}",
            np.array([len(keys), len(large)], np.int64).tobytes(), keys.tobytes(), large.astype(np.int64).tobytes(),
            counts[large].astype(np.int64).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(),
        )

    def held(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of a range, in order, and their counts."""
        held, large, more, counts = _open(f"{self.folder}/{number:08d}")
        counts = counts.astype(np.int64)
        counts[large] = more
        return held, counts

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (-1: none) and count of each key; ``keys`` are sorted."""
        rank = np.full(len(keys), -1, np.int64)
        count = np.zeros(len(keys), np.int64)
        cuts = np.concatenate([[0], np.searchsorted(keys, self.bounds), [len(keys)]])
        for number in np.flatnonzero((np.diff(cuts) > 0) & (self.sizes > 0)):
            a, b = cuts[number], cuts[number + 1]
            held, large, more, counts = _open(f"{self.folder}/{number:08d}")
            at = np.searchsorted(held, keys[a:b])
            at[at == len(held)] = 0
            hit = np.flatnonzero(held[at] == keys[a:b])
            places = at[hit]
            rank[a + hit] = places + self.offsets[number]
            found = counts[places].astype(np.int64)
            big = np.flatnonzero(found == 255)
            found[big] = more[np.searchsorted(large, places[big])]
            count[a + hit] = found
        return rank, count


@lru_cache(maxsize=4096)
def _open(uri: str) -> tuple[np.ndarray, ...]:
    raw = mapped(uri)
    n, large = raw[:16].view(np.int64).tolist()
    a, b, c = 16 + 8 * n, 16 + 8 * (n + large), 16 + 8 * (n + 2 * large)
    return raw[16:a].view(np.uint64), raw[a:b].view(np.int64), raw[b:c].view(np.int64), raw[c:]
