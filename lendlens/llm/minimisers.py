"""Windows, their minimisers, and which minimisers occur at two places or more.

A window is a run of symbols (words or bytes) of one document, a gram a shorter run. A window's minimiser is the gram in
it that comes first in a fixed scrambled order, the leftmost of equal ones. Equal windows have equal minimisers at the same offset, so
of two equal windows that start at different places the minimisers lie at different places too.
A *census* counts the different strings over each minimiser, in all documents, or two where one string comes again. Only windows
whose minimiser has a count of two or more can occur twice, and only they need to travel. A minimiser with a large count would
gather its strings in one group; its windows travel one by one, dealt by all that they hold (``Runs.split``).
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lendlens.llm.common import GOLDEN, mix64, staged
from lendlens.llm.files import new_folder
from lendlens.llm.sorted_files import ADD_UP, BLOBS, SortedFiles, added, blobs, sizes_of, unpacked

#: Bits of a place within a batch; the rest of 64 are a gram's hash.
PLACE_BITS = np.uint64(30)
_PLACE = np.uint64((1 << 30) - 1)
#: Runs that a task looks at before it may send.
SLICE = 1 << 16


def gram_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` hashed symbols, by its start; put together from runs of 1, 2, 4 and so on."""
    n = len(symbols) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    span, part, factor, out, done = 1, symbols, GOLDEN, None, 0
    with np.errstate(over="ignore"):
        while True:
            if length - done & span:
                piece = part[done : done + n]
                out = piece.copy() if out is None else out * factor + piece
                done += span
            if done == length:
                return mix64(out)
            part = part[:-span] * factor + part[span:]
            factor = factor * factor
            span *= 2


def sliding_min(x: np.ndarray, length: int) -> np.ndarray:
    """The least of each ``length`` neighbours, by the first one's place."""
    n = len(x) - length + 1
    if n <= 0:
        return x[:0]
    span, least, out, done = 1, x, None, 0
    left = length
    while True:
        if left & span:
            part = least[done : done + n]
            out = part.copy() if out is None else np.minimum(out, part, out=out)
            done += span
            left -= span
        if not left:
            return out
        least = np.minimum(least[:-span], least[span:])
        span *= 2


class Runs:
    """The runs of neighbouring windows that share one minimiser, of a batch of documents laid end to end.

    ``first`` and ``last``: places of a run's first and last window; ``anchor``: that of its minimiser; ``value``: the minimiser's hash.
    """

    def __init__(self, hashes: np.ndarray, ends: np.ndarray, gram: int, window: int):
        if len(hashes) >= 1 << 30:
            raise ValueError("a text is longer than a batch can be")
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        places = np.arange(len(hashes), dtype=np.uint64)
        order = (mix64(hashes ^ GOLDEN) >> PLACE_BITS << PLACE_BITS) | places
        least = sliding_min(order, window - gram + 1)
        counts = np.maximum(ends - starts - window + 1, 0)
        inside = np.zeros(len(least) + 1, np.int8)
        some = counts > 0
        inside[starts[some]] += 1
        np.subtract.at(inside, starts[some] + counts[some], 1)
        windows = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
        anchors = (least[windows] & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.diff(anchors, prepend=-1))
        self.first = windows[new]
        self.last = windows[np.concatenate([new[1:], [len(windows)]]).astype(np.int64) - 1] if len(new) else self.first
        self.anchor = anchors[new]
        self.value = hashes[self.anchor]
        self.hashes, self.gram, self.window = hashes, gram, window

    def __len__(self) -> int:
        return len(self.first)

    def keep(self, chosen: np.ndarray) -> None:
        self.first, self.last, self.anchor, self.value = (x[chosen] for x in (self.first, self.last, self.anchor, self.value))

    def contents(self) -> np.ndarray:
        """A hash of all that each run covers, from grams end to end."""
        last = self.last + self.window - self.gram
        out = (last - self.first).astype(np.uint64)
        for step in range(0, 2 * (self.window - self.gram) + self.gram, self.gram):
            out = mix64(out + GOLDEN ^ self.hashes[np.minimum(self.first + step, last)])
        return out

    def split(self, chosen: np.ndarray) -> None:
        """Make each window of the chosen runs a run of its own, with a hash of the whole window for its value."""
        if not chosen.any():
            return
        counts = np.where(chosen, self.last - self.first + 1, 1)
        of = np.repeat(np.arange(len(self)), counts)
        step = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.keep(of)
        alone = chosen[of]
        self.first = self.first + step
        self.last = np.where(alone, self.first, self.last)
        single = copy.copy(self)
        single.keep(alone)
        self.value[alone] = single.contents()

    def slices(self) -> Iterator[Runs]:
        for start in range(0, len(self), SLICE):
            part = copy.copy(self)
            part.keep(slice(start, start + SLICE))
            yield part


def strings_over(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """The distinct minimisers, and of each the number of different strings of its runs; two where one string comes again."""
    value, places = np.unique(runs.value, return_counts=True)
    some = np.unique(runs.contents(), return_index=True)[1]
    held, counts = np.unique(runs.value[some], return_counts=True)
    different = np.zeros(len(value), np.int64)
    different[np.searchsorted(value, held)] = counts
    return value, np.maximum(different, np.minimum(places, 2))


def census(docs: DataFrame, runs: Callable[[pa.RecordBatch], Iterator[Runs]], name: str) -> SortedFiles:
    """The minimisers with two places or more, with the counts of their strings added up. ``runs``: those of a batch of rows."""
    folder = new_folder(docs.sparkSession, name)
    ranges = max(8, docs.rdd.getNumPartitions())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0
        for batch in batches:
            for found in runs(batch):
                k, c = strings_over(found)
                keys.append(k)
                counts.append(c)
                size += len(k)
                if size > ADD_UP:
                    yield blobs(*added(keys, counts), ranges)
                    keys, counts, size = [], [], 0
        yield blobs(*added(keys, counts), ranges)

    def written(table: pa.Table) -> pa.Table:
        number = table.column("range")[0].as_py()
        keys, counts = unpacked(table)
        again = counts > 1
        SortedFiles.write(folder, number, keys[again], counts[again])
        return pa.table({"range": pa.array([number], pa.int32()), "n": [int(again.sum())]})

    sent = docs.mapInArrow(counted, BLOBS)
    made = staged(sent.groupBy("range").applyInArrow(written, "range int, n long")).collect()  # a row for each range
    return SortedFiles(folder, sizes_of([(r["range"], r["n"]) for r in made], ranges))


def travelling(files: SortedFiles, runs: Runs, hot: int) -> Iterator[Runs]:
    """Of the runs those that could occur twice, a slice at a time; where a minimiser has more than ``hot`` strings, window by window."""
    distinct, inverse = np.unique(runs.value, return_inverse=True)
    counts = files.look_up(distinct)[1][inverse]
    runs.keep(counts > 0)
    runs.split(counts[counts > 0] > hot)
    return runs.slices()
