"""Mixing sources to target weights by Pareto order sampling.

Each source has a target of words. Longer documents are worth more copies: a document of size class k (its size has k
binary digits) counts ``2 ** (exponent * k)``, and the expected copies of a class are that worth times a factor of its
source, ``max_copies`` at most, with the factor set so that the expected words are the target. The whole part of the
expected copies is certain. The fraction p that is left is the inclusion probability in a sample of one more copy:
documents are ranked within their source by their random odds u / (1 - u) over their inclusion odds p / (1 - p), and
the sample is the start of that order. Its size is fixed in words: it ends before the document that would pass the
source's target. One document from the rest of the order then closes the gap, the one whose size is nearest to it.

All of it is DataFrame operations. The running total along the order never brings a source into one task: ranks are
mapped to (0, 1) and summed in ``BINS`` bins per source, the bin in which the total passes the target is cut in
``BINS`` bins again, and only the documents of one such bin are put in order one by one. The outcome is a cut for
each source and a copy count for each of its size classes, small tables by which each row is decided on its own.

Defined cases: a null text has size 0; documents of size 0 are never taken; null sources are one source, the last in
order; u depends on the seed and doc_id alone, so reruns agree; rows that repeat a doc_id and size share one rank and are
decided in the order of their sums, all or none in the cut; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.llm.common import WORD, staged, text_of

BINS = 4096
EXPONENT = 0.125


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def _uniform(doc_id: Column, seed: int) -> Column:
    """Within (0, 1), from the seed and doc_id."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 12)
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_copies: float) -> DataFrame:
    """source, source_size, target. ``sizes``: source, size.

    A source's target is a level times its weight, or ``max_copies`` times its size if that is less; the level is the
    one at which the targets add up. Sources are in order of that limit by weight, so those at their limit come first.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    limits = totals.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(max_copies)))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    spent = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    rest = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - spent) / rest
    steps = limits.withColumn("level", level)
    # Past the first source below its limit the steps' levels only fall.
    final = F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(whole)
    target = F.least("limit", F.coalesce(final * F.col("weight"), F.col("limit")))
    return steps.select("source", "source_size", target.alias("target"))


def _copies_by_class(by_class: DataFrame, wanted: DataFrame, max_copies: float, exponent: float) -> DataFrame:
    """source, class, expected copies: the worth of the class times a factor of its source, ``max_copies`` at most."""
    worth = F.pow(F.lit(2.0), F.col("class") * F.lit(exponent))
    rows = by_class.join(wanted, by_class["source"].eqNullSafe(wanted["source"])).select(
        by_class["source"], "class", "words", "target", worth.alias("worth")
    )
    by_worth = Window.partitionBy("source").orderBy(F.col("class").desc())
    spent = F.coalesce(F.sum("words").over(by_worth.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * max_copies
    rest = F.sum(F.col("words") * F.col("worth")).over(by_worth.rowsBetween(0, Window.unboundedFollowing))
    steps = rows.withColumn("factor", (F.col("target") - spent) / rest)
    fits = F.col("factor") * F.col("worth") <= F.lit(max_copies) * (1 + 1e-12)
    first = F.max(F.when(fits, F.struct("class", "factor"))).over(Window.partitionBy("source"))["factor"]
    expected = F.least(F.lit(float(max_copies)), F.coalesce(first * F.col("worth"), F.lit(float(max_copies))))
    # Next to a whole number it is that number: what is left over would be an error of rounding.
    near = F.round(expected)
    expected = F.when(F.abs(expected - near) < 1e-9, near).otherwise(expected)
    return steps.select("source", "class", F.greatest(expected, F.lit(0.0)).alias("expected"))


def _passing_bin(binned: DataFrame, room: DataFrame) -> DataFrame:
    """For each source the bin in which the running total passes the room, and the room left when the bin begins."""
    bins = binned.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    rows = bins.join(room, bins["source"].eqNullSafe(room["source"])).select(bins["source"], "bin", "words", "room")
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    passed = rows.withColumn("upto", upto).where("upto > room")
    first = passed.groupBy("source").agg(F.min(F.struct("bin", (F.col("room") - F.col("upto") + F.col("words")).alias("room"))).alias("first"))
    return first.select("source", "first.bin", "first.room")


def cuts(sized: DataFrame, weights: Sequence[float], share: float, max_copies: int, exponent: float) -> tuple[DataFrame, DataFrame]:
    """Two small tables: per source and class the expected copies; per source where its sample ends.

    ``sized``: doc_id, source, size, class, u.
    """
    wanted = staged(targets(sized, weights, share, max_copies))
    by_class = sized.where("size > 0").groupBy("source", "class").agg(F.sum("size").alias("words"))
    expected = staged(_copies_by_class(by_class, wanted, float(max_copies), exponent))
    certain = by_class.join(
        expected, by_class["source"].eqNullSafe(expected["source"]) & (by_class["class"] == expected["class"])
    ).groupBy(by_class["source"]).agg(F.sum(F.col("words") * F.floor("expected")).alias("certain"))
    room = wanted.join(certain, wanted["source"].eqNullSafe(certain["source"])).select(
        wanted["source"], (F.col("target") - F.col("certain")).alias("room")
    )
    room = staged(room)
    ranked = with_rank(sized, expected).where("rank is not null").select("doc_id", "source", "size", "rank")
    ranked = staged(ranked.withColumn("bin", F.floor(F.col("rank") * BINS)))
    outer = staged(_passing_bin(ranked, room))
    part = ranked.alias("r").join(
        outer.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.bin") == F.col("o.bin"))
    ).select("r.doc_id", "r.source", "r.size", "r.rank", (F.floor(F.col("rank") * BINS * BINS) % BINS).alias("bin"))
    inner = staged(_passing_bin(part, outer.select("source", "room")))
    last = part.alias("p").join(
        inner.alias("i"), F.col("p.source").eqNullSafe(F.col("i.source")) & (F.col("p.bin") == F.col("i.bin"))
    ).select("p.doc_id", "p.source", "p.size", "p.rank", "i.room")
    # Rows of equal rank and doc_id come together, as one step of the running total.
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_id"))
    here = F.sum("size").over(Window.partitionBy("source", "rank", "doc_id"))
    steps = last.withColumn("upto", upto).withColumn("step", here).where(F.col("upto") > F.col("room"))
    crossing = steps.groupBy("source").agg(F.min(F.struct("rank", "doc_id", "upto", "step", "room")).alias("c"))
    cut = staged(
        crossing.select(
            "source",
            F.col("c.rank").alias("cut_rank"),
            F.col("c.doc_id").alias("cut_id"),
            (F.col("c.room") - F.col("c.upto") + F.col("c.step")).alias("gap"),
        )
    )
    # The document that closes the gap comes from the rest of the order.
    rest = (F.col("rank") > F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("doc_id") >= F.col("cut_id")))
    beyond = ranked.alias("r").join(cut.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))).where(rest)
    miss = F.abs(F.col("size") - F.col("gap"))
    nearest = beyond.where(miss < F.col("gap")).groupBy("r.source").agg(F.min(F.struct(miss.alias("miss"), "rank", "doc_id")).alias("n"))
    nearest = nearest.select("source", F.col("n.doc_id").alias("close_id"), F.col("n.rank").alias("close_rank"))
    cut = cut.alias("c").join(nearest.alias("n"), F.col("c.source").eqNullSafe(F.col("n.source")), "left")
    ends = wanted.alias("w").join(cut, F.col("w.source").eqNullSafe(F.col("c.source")), "left")
    names = ["cut_rank", "cut_id", "close_id", "close_rank"]
    return expected, staged(ends.select("w.source", "w.source_size", "w.target", *names))


def with_rank(sized: DataFrame, expected: DataFrame) -> DataFrame:
    """Adds the expected copies and the rank: odds of u over odds of the fraction, mapped to (0, 1); null where no copy is drawn."""
    rows = sized.alias("s").join(
        expected.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")) & (F.col("s.class") == F.col("e.class")), "left"
    ).select("s.*", F.coalesce("expected", F.lit(0.0)).alias("expected"))
    p = F.col("expected") - F.floor("expected")
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - p) / p)
    return rows.withColumn("rank", F.when((p > 0) & (F.col("size") > 0), odds / (1 + odds)))


def sized_rows(docs: DataFrame, seed: int, text: str = "text") -> DataFrame:
    """The columns of ``docs`` in a struct, with what the sampling needs."""
    size = word_count(text)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    return rows.select("*", F.length(F.bin("size")).alias("class"), _uniform(F.col("doc_id"), seed).alias("u"))


def with_copies(sized: DataFrame, expected: DataFrame, ends: DataFrame) -> DataFrame:
    """Adds ``copies``, source_size and target; each row is decided on its own."""
    rows = with_rank(sized, expected).alias("s").join(ends.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left")
    before = (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("s.doc_id") < F.col("cut_id")))
    closing = (F.col("rank") == F.col("close_rank")) & F.col("s.doc_id").eqNullSafe(F.col("close_id"))
    drawn = F.col("rank").isNotNull() & (F.col("cut_rank").isNull() | before | closing)
    copies = F.when(F.col("size") > 0, F.floor("expected") + F.coalesce(drawn, F.lit(False)).cast("long")).otherwise(0)
    return rows.select("s.*", "e.source_size", "e.target", copies.cast("long").alias("copies"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_copies: int = 2,
    exponent: float = EXPONENT,
    seed: int = 20240901,
) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken, copies."""
    sized = staged(sized_rows(docs, seed).drop("row"))
    expected, ends = cuts(sized, weights, share, max_copies, exponent)
    rows = with_copies(sized, expected, ends)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return rows.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken, "copies")


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_copies: int = 2,
    exponent: float = EXPONENT,
    seed: int = 20240901,
) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    rows = sized_rows(docs, seed)
    expected, ends = cuts(staged(rows.drop("row")), weights, share, max_copies, exponent)
    taken = with_copies(rows, expected, ends).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
