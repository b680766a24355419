"""Pages and exact row numbers of an ordered result."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from itertools import accumulate
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.session import staged

PAGE_SIZE = 10

#: Up to this position a page is cut from the first rows of each partition.
SHALLOW = 1000

# monotonically_increasing_id(): partition number above, row in partition below.
_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1


def page(df: DataFrame, order: list, start: int, count: int) -> DataFrame:
    """Rows ``start`` to ``start + count`` of the order, counted from 0.

    Up to position ``SHALLOW`` each partition gives its first rows and the rest
    is never sorted. A page beyond is read from the ranked rows; for several
    pages of one result, rank it once and ask the ``Ranked`` for each.
    """
    _check_part(start, count)
    if start + count <= SHALLOW:
        return df.orderBy(*order).offset(start).limit(count)
    return ranked(df, order).page(start, count)


def _check_part(start: int, count: int) -> None:
    if start < 0 or count < 0:
        raise ValueError("start and count must not be negative")


@dataclass(frozen=True)
class Ranked:
    """Rows laid out once in their order, by ranges, with the number of rows in each range.

    ``rows`` has the partition of the range sort and the place in it as one
    number, ``_place``; ``sizes`` the partitions in their order. A position is
    looked up in the sizes and read by a filter on ``_place``, which the file
    statistics narrow to the one or two files that hold it.
    """

    rows: DataFrame
    sizes: list[tuple[int, int]]

    @property
    def count(self) -> int:
        return sum(n for _, n in self.sizes)

    def _place_of(self, position: int) -> int:
        for part, n in self.sizes:
            if position < n:
                return (part << _ROW_BITS) + position
            position -= n
        raise IndexError("beyond the last row")

    def _within(self, start: int, stop: int) -> Column:
        """Whether a row is at one of the positions from ``start`` to before ``stop``."""
        stop = min(stop, self.count)
        if start >= stop:
            return F.lit(False)
        return F.col("_place").between(self._place_of(start), self._place_of(stop - 1))

    def page(self, start: int, count: int) -> DataFrame:
        """``count`` rows are read and sorted, whatever the position."""
        _check_part(start, count)
        found = self.rows.filter(self._within(start, start + count))
        return found.orderBy("_place").drop("_place")

    def row_at(self, position: int) -> DataFrame:
        return self.page(position, 1)

    def numbered(self, name: str = "row_number") -> DataFrame:
        """Add the 1-based position of each row."""
        spark = self.rows.sparkSession
        before = [0, *accumulate(n for _, n in self.sizes)]
        # One row per sort partition, whatever the number of rows.
        offsets = spark.createDataFrame(
            [(part, first) for (part, _), first in zip(self.sizes, before)], "_part long, _offset long"
        )
        in_part = F.col("_place").bitwiseAND(F.lit(_ROW_MASK))
        rows = self.rows.withColumn("_part", F.shiftright("_place", _ROW_BITS))
        columns = [c for c in self.rows.columns if c != "_place"]
        number = (F.col("_offset") + in_part + 1).alias(name)
        return rows.join(F.broadcast(offsets), "_part").select(*columns, number)

    def sliced(self, part: slice) -> DataFrame:
        """A Python slice of the rows; negative ends count from the last row."""
        start, stop, step = part.indices(self.count)
        if step == 1:
            return self.page(start, max(0, stop - start))
        if step < 1:
            raise ValueError("step must be positive")
        place = F.col("row_number") - 1
        near = replace(self, rows=self.rows.filter(self._within(start, stop)))
        found = near.numbered().filter((place - start) % step == 0)
        return found.orderBy("row_number").drop("row_number")


def ranked(df: DataFrame, order: list) -> Ranked:
    """Sort by ranges and write once; the sizes, one for each partition, are all that reaches the driver.

    The order should identify a row, which also spreads equal sort values.
    """
    rows = staged(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", _ROW_BITS).alias("part")
    sizes = rows.groupBy(part).agg(F.count("*").alias("n")).collect()
    return Ranked(rows, sorted((r["part"], r["n"]) for r in sizes))


def page_after(df: DataFrame, order: list[str], last_key: list, count: int) -> DataFrame:
    """The ``count`` rows that follow the key of the row last seen.

    To go on from a page: earlier rows are filtered out instead of sorted and skipped.
    Ascending, non-null order columns that identify a row.
    """
    return df.filter(_beyond(order, last_key)).orderBy(*order).limit(count)


def _beyond(order: list[str], last_key: list) -> Column:
    """Lexicographic ``order > last_key``."""

    def step(rest: Column, pair: tuple) -> Column:
        name, value = pair
        return (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & rest)

    return reduce(step, reversed(list(zip(order, last_key))), F.lit(False))


def row_at(df: DataFrame, order: list, position: int) -> DataFrame:
    return page(df, order, position, 1)


def numbered(df: DataFrame, order: list, name: str = "row_number") -> DataFrame:
    """Add the exact 1-based position of each row in the order.

    No step brings the rows together, unlike a window without partitions.
    """
    return ranked(df, order).numbered(name)


def every_nth(
    df: DataFrame, order: list, step: int, start: int = 0, stop: int | None = None
) -> DataFrame:
    """The slice ``[start:stop:step]`` of the ordered rows, with their numbers."""
    if step < 1 or start < 0:
        raise ValueError("step must be positive and start not negative")
    place = F.col("row_number") - 1
    wanted = (place >= start) & ((place - start) % step == 0)
    if stop is not None:
        wanted &= place < stop
    return numbered(df, order).filter(wanted)


def sliced(df: DataFrame, order: list, part: slice) -> DataFrame:
    """A Python slice of the ordered rows; negative ends count from the last row."""
    start = part.start or 0
    if part.step in (None, 1) and start >= 0 and part.stop is not None and part.stop >= 0:
        return page(df, order, start, max(0, part.stop - start))
    return ranked(df, order).sliced(part)


def page_count(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """Rows and pages of a result, as one row (rows, pages)."""
    if size < 1:
        raise ValueError("a page holds at least one row")
    pages = F.ceil(F.count("*") / F.lit(size)).cast("bigint")
    return df.agg(F.count("*").alias("rows"), pages.alias("pages"))


def current_page(wanted: int, rows: int, size: int = PAGE_SIZE) -> int:
    """The wanted 0-based page, held back to the last one."""
    return max(0, min(wanted, ceil(rows / size) - 1))
