"""Quality rules with a hashed n-gram log-likelihood ratio between trusted texts and the raw corpus.

Words, and each with the next one, are hashed whole into ``BUCKETS`` buckets. Two multinomials over the buckets are counted: one over
the trusted texts (those that ``labels`` marks as of good quality), one over all documents. The score of a text is the
mean over its n-grams of the log of trusted over raw probability, both with ``SMOOTH`` added to each count; a gram is not
counted for itself, or in a small corpus texts would be far from the trusted ones just for not being among them. A text is
kept if it passes the base rules and its score is ``THRESHOLD`` or more; there is no random draw. The threshold is that at which,
with two thirds of the labels trusted, all texts that the other third marks as good were kept and few of the bad ones
(see the README for the rates).

All of it is DataFrame and SQL functions. The counts are partial sums of at most ``2 * BUCKETS`` rows a task, and the
ratio is one array of ``BUCKETS`` numbers, whatever the size of the corpus, that reaches the rows as a constant.
The trusted doc_ids are packed as bits, one number for 64 neighbouring IDs, in a table of a quarter of a byte for each
document; Spark chooses how to join the texts with it by its size. A row's own rules are array functions of
that row.

Defined cases: a null text is the empty text: no words, base_failed; a doc_id that labels mark both ways is trusted if
any row says so; a document without doc_id is not trusted; rows that repeat are counted as often as they stand; an empty
table gives no rows; without trusted texts each ratio is 0, so the base rules decide; windows of three words are compared by
a 64-bit hash of the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import WORD, staged, text_of

BUCKETS = 100_000
SMOOTH = 1.0
THRESHOLD = -0.3


def _words() -> Column:
    return F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def _bucket(x: Column, buckets: int) -> Column:
    return F.pmod(x, F.lit(buckets)).cast("int")


def _pairs(hashes: str, buckets: int) -> Column:
    """Buckets of each word's hash with the next one's, the last word's with nothing. ``hashes`` must be a column, as each
    element looks up another."""
    return F.transform(hashes, lambda x, i: _bucket(F.xxhash64(x, F.get(hashes, i + 1)), buckets))


def trusted_masks(labels: DataFrame) -> DataFrame:
    """block, mask: a bit for each of 64 neighbouring doc_ids that any row of ``labels`` marks as of good quality."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("doc_id").bitwiseAND(63).cast("int"))
    return good.groupBy(F.shiftright("doc_id", 6).alias("block")).agg(F.bit_or(bit).alias("mask"))


def with_trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, trusted of each document."""
    id = F.col("doc_id").cast("long")
    rows = docs.select("doc_id", "text", F.shiftright(id, 6).alias("block"), id.bitwiseAND(63).cast("int").alias("place"))
    bit = F.call_function("shiftrightunsigned", F.col("mask"), F.col("place")).bitwiseAND(1) == 1
    trusted = F.coalesce(bit, F.lit(False)).alias("trusted")
    return rows.join(staged(trusted_masks(labels)), "block", "left").select("doc_id", text_of().alias("text"), trusted)


def log_ratios(rows: DataFrame, buckets: int, smooth: float) -> DataFrame:
    """One row with two arrays: the log of trusted over raw probability of each bucket, for a gram of a text that isn't
    trusted and for one that is. The gram itself is taken out of the counts it is in.

    ``rows``: text, trusted.
    """
    spread = rows.select("trusted", _hashes(_words()).alias("hashes"))
    grams = F.concat(F.transform("hashes", lambda x: _bucket(x, buckets)), _pairs("hashes", buckets))
    spread = spread.select("trusted", F.explode(grams).alias("bucket"))
    counts = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("trusted").alias("good"))
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good")
    )
    packed = filled.agg(
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "good"))).alias("rows"),
        F.sum("raw").alias("raw"),
        F.sum("good").alias("good"),
    )
    more = smooth * buckets

    def ratio(own: int):
        good = lambda x: F.log((F.greatest(x["good"] - own, F.lit(0)) + smooth) / (F.col("good") + more))
        raw = lambda x: F.log((F.greatest(x["raw"] - 1, F.lit(0)) + smooth) / (F.col("raw") + more))
        return F.transform("rows", lambda x: F.when(F.col("good") > 0, good(x) - raw(x)).otherwise(F.lit(0.0)))

    return packed.select(ratio(0).alias("other"), ratio(1).alias("trusted"))


def _placed(windows: Column) -> Column:
    """Hash and start of each window in order of the hash; null if no hash comes twice."""
    again = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(again, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def _repeated_words(placed: str) -> Column:
    """Words within windows whose hash comes twice or more. ``placed`` must be a column, as each element looks up others."""

    def again(x: Column, i: Column) -> Column:
        same = lambda other: F.coalesce(F.get(placed, other)["h"] == x["h"], F.lit(False))
        return same(i - 1) | same(i + 1)

    starts = F.sort_array(F.transform(F.filter(placed, again), lambda x: x["i"]))
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    total = F.aggregate(
        starts, zero, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
    )
    return F.coalesce(total["n"], F.lit(0))


def report(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = BUCKETS,
    smooth: float = SMOOTH,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """A row for each document: doc_id, the base numbers, base_failed, llr, kept.

    Write the rows before filtering by them: Spark would move the filter below the arrays it is reckoned from, and work
    them out for each element.
    """
    rows = with_trusted(docs, labels)
    numbers = log_ratios(rows, buckets, smooth).first()
    # Constants to Spark, not an expression for each number.
    other, trusted = (F.split(F.lit(" ".join(map(repr, numbers[n]))), " ").cast("array<double>") for n in ("other", "trusted"))
    rows = rows.select("doc_id", "text", "trusted", _words().alias("words"))
    rows = rows.select(
        "doc_id", "text", "trusted", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), _hashes(F.col("words")).alias("hashes"),
    )
    windows = F.transform("hashes", lambda x, i: F.xxhash64(x, F.get("hashes", i + 1), F.get("hashes", i + 2)))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    rows = rows.select(
        "doc_id", "trusted", "n_words", "word_chars", "hashes",
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.slice(windows, 1, F.greatest(F.size("hashes") - 2, F.lit(0))).alias("windows"),
        _pairs("hashes", buckets).alias("pairs"),
    )
    rows = rows.select("*", _placed(F.col("windows")).alias("placed"))
    zero = F.lit(0.0)

    def total(ratio: Column) -> Column:
        words = F.aggregate("hashes", zero, lambda acc, x: acc + F.get(ratio, _bucket(x, buckets)))
        return words + F.aggregate("pairs", zero, lambda acc, b: acc + F.get(ratio, b))

    llr = F.when(F.col("trusted"), total(trusted)).otherwise(total(other)) / (2 * F.col("n_words"))
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words("placed").cast("long").alias("n_repeat_words"),
        F.when(F.col("n_words") > 0, llr).otherwise(zero).alias("llr"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold)))
