"""Connected components of a graph in a table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.session import staged

EDGES = "a long, b long"


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round. A node's neighbours (larger ones, or itself and smaller ones) are tied to the least of them all."""
    if large:
        sides = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    sides = staged(sides.where("a <> b"))
    least = staged(sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")))
    if large:
        tied = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        tied = sides.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return staged(tied.where("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of each node with an edge, from edges a, b."""
    edges = staged(edges.select("a", "b"))
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    state = None
    while True:
        edges = _stars(_stars(edges, True), False)
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
