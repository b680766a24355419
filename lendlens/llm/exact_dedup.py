"""Exact duplicates found through a minimal perfect hash over the texts of the past.

Texts are equal when they are the same after each run of blanks becomes one space. The distinct SHA-256 digests of
a corpus already taken in (the *history*) are dealt into shards of at most about ``SHARD_KEYS`` digests, old or new. A shard's digests
get a minimal perfect hash function: bit arrays in levels, where a key that is alone at its place in a level's array
sets the bit, and the others go on to the next level. A key's slot is the number of bits set before its own. A slot
holds the full digest and its winner's locator (the smallest doc_id and the number of rows).

A key that never was in the history also lands on some slot, so each lookup compares all 32 bytes. Members are
repeats of the past; nonmembers are grouped among themselves by digest.

Rows are reduced to one per digest before any shuffle, so a text that a third of all rows share is one row per task.
The rows are then joined with the classes of two rows or more, which are few and written to a table first: Spark
splits a large partition of such a join by itself.

Defined cases: a null text is the empty text; null doc_ids come after all others, and a group of only null doc_ids
keeps all its rows in the report; rows that repeat doc_id and text are all marked as kept in the report and counted in
group_size, while ``distinct_documents`` lets one of them stay; an empty table or history gives no rows or members.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import BLANKS, GOLDEN, mix64, staged, text_of

SHARD_KEYS = 2048
#: Places for each key in a level's bit array.
ROOM = 2
INDEX = "shard long, sizes array<int>, bits binary, digests binary, keep_ids array<long>, counts array<long>"


def text_digest(text: str = "text") -> Column:
    """Binary SHA-256 of the text with each run of blanks made one space."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(text), BLANKS, " "), 256))


def _places(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each digest (rows of four numbers) in the bit array of a level."""
    with np.errstate(over="ignore"):
        step = GOLDEN * np.uint64(2 * level + 1)
        mixed = mix64(digests[:, 1] + step) ^ mix64(digests[:, 2] ^ step) + digests[:, 3]
    return (mix64(mixed) % np.uint64(size)).astype(np.int64)


def build_hash(digests: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and the bits of all levels for distinct digests."""
    sizes: list[int] = []
    levels: list[np.ndarray] = []
    left = digests
    while len(left):
        size = ROOM * len(left)
        places = _places(left, len(sizes), size)
        alone = np.bincount(places, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        left = left[~alone[places]]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool)


def slots(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each digest; -1 where no level has its bit, so that it is no member."""
    found = np.full(len(digests), -1, np.int64)
    before = np.cumsum(bits) - 1
    open_ = np.arange(len(digests))
    start = 0
    for level, size in enumerate(sizes):
        places = start + _places(digests[open_], level, size)
        hit = bits[places]
        found[open_[hit]] = before[places[hit]]
        open_ = open_[~hit]
        start += size
    return found


def _numbers(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    digests = _numbers(rows["digest"])
    sizes, bits = build_hash(digests)
    order = np.argsort(slots(digests, sizes, bits))
    return pd.DataFrame(
        {
            "shard": [rows["shard"].iloc[0]],
            "sizes": [sizes],
            "bits": [np.packbits(bits).tobytes()],
            "digests": [digests[order].tobytes()],
            "keep_ids": [rows["keep_id"].astype("Int64").iloc[order].astype(object).where(lambda x: x.notna(), None).tolist()],
            "counts": [rows["n"].iloc[order].tolist()],
        }
    )


def _look_up_shard(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Of each new digest whether it is a member, and the locator in its slot."""
    out = new[["digest"]].copy()
    out["member"] = False
    keep: list[int | None] = [None] * len(new)
    count = np.zeros(len(new), np.int64)
    if len(index) and len(new):
        row = index.iloc[0]
        sizes = list(row["sizes"])
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        held = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
        digests = _numbers(new["digest"])
        at = slots(digests, sizes, bits)
        member = (at >= 0) & (held[at] == digests).all(axis=1)
        out["member"] = member
        for i in np.flatnonzero(member):
            locator = row["keep_ids"][at[i]]
            keep[i] = None if locator is None or locator != locator else int(locator)
            count[i] = row["counts"][at[i]]
    out["past_keep"] = pd.array(keep, dtype="Int64")
    out["past_n"] = count
    return out


def _one_per_digest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def _sharded(digests: DataFrame, shards: int) -> DataFrame:
    return digests.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """A row for each shard of the history's distinct digests. ``history``: digest, keep_id, n."""
    return _sharded(history, shards).groupBy("shard").applyInPandas(_build_shard, INDEX)


def look_up(new: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """digest, member, past_keep, past_n of each row of ``new`` (one per digest)."""
    keyed = _sharded(new, shards).groupBy("shard")
    schema = "digest binary, member boolean, past_keep long, past_n long"
    return keyed.cogroup(index.groupBy("shard")).applyInPandas(_look_up_shard, schema)


def classes(docs: DataFrame, in_history: Column, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(the rows as doc_id and digest, a row for each digest: digest, keep_id, n), both written to tables."""
    rows = staged(
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_digest(text).alias("digest"), F.coalesce(in_history, F.lit(False)).alias("past"))
    )
    history = staged(_one_per_digest(rows.where("past")))
    new = staged(_one_per_digest(rows.where("not past")))
    shards = max(1, -(-max(history.count(), new.count()) // SHARD_KEYS))  # new digests are dealt by the same shards
    index = staged(build_index(history, shards))
    found = look_up(new.select("digest"), index, shards)
    joined = new.join(found, "digest", "left")
    repeats = F.col("member")
    merged = joined.select(
        "digest",
        F.least("keep_id", F.when(repeats, F.col("past_keep"))).alias("keep_id"),
        (F.col("n") + F.when(repeats, F.col("past_n")).otherwise(0)).alias("n"),
        repeats.alias("member"),
    )
    merged = staged(merged)
    only_past = history.join(merged.where("member"), "digest", "left_anti").select("digest", "keep_id", "n")
    return rows, staged(merged.select("digest", "keep_id", "n").unionByName(only_past))


def past_half(doc_id: str = "doc_id") -> Column:
    """The rows the queries take for the history: half of all, by a hash of the doc_id."""
    return F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(2)) == 0


def report(docs: DataFrame, in_history: Column | None = None) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, groups = classes(docs, past_half() if in_history is None else in_history)
    larger = groups.where("n > 1")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(larger, "digest", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, in_history: Column | None = None) -> DataFrame:
    """The documents that stay, one of each group, with the columns of ``docs``."""
    _, groups = classes(docs, past_half() if in_history is None else in_history)
    rows = docs.select(F.struct("*").alias("row"), text_digest().alias("digest"), F.col("doc_id").cast("long").alias("keep_id"))
    same = rows["digest"].eqNullSafe(groups["digest"]) & rows["keep_id"].eqNullSafe(groups["keep_id"])
    return rows.join(groups, same, "left_semi").dropDuplicates(["digest", "keep_id"]).select("row.*")


ORACLE = """
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
