"""Who holds an item when: interval questions answered without pairing loans.

Loans and questions are aggregated to one row per item and calendar day
(partially, before the shuffle), so the running totals of one item span at most
the days of the calendar, however many loans it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lendlens.functions.dates import loan_end
from lendlens.operators.sizing import narrowed

def _through_day() -> WindowSpec:
    """Rows of one item up to and including a day."""
    days = Window.partitionBy("book_id").orderBy("day")
    return days.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def furthest_return(loans: DataFrame, days: DataFrame) -> DataFrame:
    """For each (book_id, last_day): the latest return of a loan begun by then.

    One row (book_id, last_day, reach) per distinct input pair; ``reach`` is
    null when no loan had begun, and the calendar's end while one is still out.
    """
    dated = loans.filter(F.col("start_date").isNotNull())
    begun = narrowed(dated, days, "book_id").select(
        "book_id",
        F.col("start_date").alias("day"),
        loan_end(F.col("return_date")).alias("reach"),
        F.lit(False).alias("asked"),
    )
    asked = days.select(
        "book_id",
        F.col("last_day").alias("day"),
        F.lit(None).cast("date").alias("reach"),
        F.lit(True).alias("asked"),
    )
    per_day = (
        begun.unionByName(asked)
        .groupBy("book_id", "day")
        .agg(F.max("reach").alias("reach"), F.max("asked").alias("asked"))
    )
    running = per_day.withColumn("reach", F.max("reach").over(_through_day()))
    return running.filter("asked").select("book_id", F.col("day").alias("last_day"), "reach")


def spans(loans: DataFrame, *extra: str) -> DataFrame:
    """Half-open intervals (book_id, first, last) of loans with usable dates."""
    return loans.select(
        *extra,
        "book_id",
        F.col("start_date").alias("first"),
        loan_end(F.col("return_date")).alias("last"),
    ).filter("book_id IS NOT NULL AND first <= last")


def overlap_flags(loans: DataFrame) -> DataFrame:
    """Loans (loan_id, book_id) that overlap another loan of their item.

    Two sides are looked at. Before: the latest end of the spans with a length
    begun on an earlier day. After: the next day on which anything begins. A
    span with a length overlaps if one begins with it, one begun before it ends
    within or after it, or anything begins before it ends; a span without one
    overlaps only strictly inside another.

    One row per item and first day goes through the windows, and only days that
    could flag a loan meet the loans again.
    """
    all_spans = spans(loans.withColumnRenamed("id", "loan_id"), "loan_id")
    has_length = F.col("first") < F.col("last")
    per_day = all_spans.groupBy("book_id", "first").agg(
        F.max(F.when(has_length, F.col("last"))).alias("reach"), F.count_if(has_length).alias("n")
    )
    days = Window.partitionBy("book_id").orderBy("first")
    before = F.max("reach").over(days.rowsBetween(Window.unboundedPreceding, -1))
    sides = per_day.select(
        "book_id",
        "first",
        F.coalesce(before > F.col("first"), F.lit(False)).alias("covered"),
        (F.col("n") > 1).alias("shared"),
        F.lead("first").over(days).alias("next"),
    ).filter("covered OR shared OR next IS NOT NULL")
    after = F.col("shared") | F.coalesce(F.col("next") < F.col("last"), F.lit(False))
    hit = F.col("covered") | (has_length & after)
    return all_spans.join(sides, ["book_id", "first"]).filter(hit).select("loan_id", "book_id")
