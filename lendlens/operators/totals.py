"""Totals of the loans by borrower and by item, kept beside a snapshot and carried on with each batch.

A report over all loans need not read them again after each batch: counts add up, and the latest visit is a maximum.
Totals have one row for each borrower and each item that has loans; loans without such a key are in none. What is
carried on moves rows in proportion to the totals and the batch, not to the loans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.operators.sizing import narrowed
from lendlens.session import staged

@dataclass(frozen=True)
class Totals:
    """``by_client``: client_id, n, still_out, seen. ``by_book``: book_id, n."""

    by_client: DataFrame
    by_book: DataFrame


def _seen() -> Column:
    """The day a borrower was last seen with a loan."""
    return F.coalesce("return_date", "start_date")


def _summed(rows: DataFrame, key: str, *columns: Column) -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*columns)


def count_loans(loans: DataFrame) -> Totals:
    """The totals of these loans, from the loans themselves."""
    n = F.count("*").alias("n")
    out = F.count_if(F.col("return_date").isNull()).alias("still_out")
    return Totals(
        _summed(loans, "client_id", n, out, F.max(_seen()).alias("seen")), _summed(loans, "book_id", n)
    )


def after_append(totals: Totals, new_loans: DataFrame) -> Totals:
    """The totals with those of new loans added; the loans held before are not read."""
    new = count_loans(new_loans)
    n, out = F.sum("n").alias("n"), F.sum("still_out").alias("still_out")
    clients, books = totals.by_client.unionByName(new.by_client), totals.by_book.unionByName(new.by_book)
    return Totals(_summed(clients, "client_id", n, out, F.max("seen").alias("seen")), _summed(books, "book_id", n))


def after_change(totals: Totals, gone: DataFrame, come: DataFrame, loans: DataFrame) -> Totals:
    """The totals after loans changed: ``gone`` the rows as they were, ``come`` as they are now.

    A deleted loan is in ``gone`` alone, a new one in ``come`` alone. Counts go by the difference. A latest visit can
    fall only where a row that held it is gone; of ``loans``, the table after the change, those of such borrowers
    are read for it.
    """
    sign = F.col("sign")
    rows = gone.withColumn("sign", F.lit(-1)).unionByName(come.withColumn("sign", F.lit(1)), allowMissingColumns=True)
    none = F.lit(None).cast("date")
    n = F.sum(sign).alias("n")
    moved = _summed(
        rows,
        "client_id",
        n,
        F.sum(F.when(F.col("return_date").isNull(), sign).otherwise(0)).alias("still_out"),
        F.max(F.when(sign > 0, _seen())).alias("seen"),
        F.max(F.when(sign < 0, _seen())).alias("lost"),
    )
    both = totals.by_client.withColumn("lost", none).unionByName(moved)
    sums = [F.sum("n").alias("n"), F.sum("still_out").alias("still_out")]
    clients = staged(_summed(both, "client_id", *sums, F.max("seen").alias("seen"), F.max("lost").alias("lost")).filter("n > 0"))
    # Where a row that came has the day of the one lost, counting again finds that day.
    stale = F.col("lost") >= F.col("seen")
    fallen = clients.filter(stale).select("client_id")
    again = _summed(narrowed(loans, fallen, "client_id"), "client_id", F.max(_seen()).alias("again"))
    seen = F.when(stale, F.col("again")).otherwise(F.col("seen")).alias("seen")
    by_client = clients.join(again, "client_id", "left").select("client_id", "n", "still_out", seen)
    books = totals.by_book.unionByName(_summed(rows, "book_id", n))
    return Totals(by_client, _summed(books, "book_id", F.sum("n").alias("n")).filter("n > 0"))


def write_totals(totals: Totals, path: str) -> None:
    totals.by_client.write.parquet(f"{path}/by_client")
    totals.by_book.write.parquet(f"{path}/by_book")


def read_totals(spark: SparkSession, path: str) -> Totals:
    clients = "client_id bigint, n bigint, still_out bigint, seen date"
    return Totals(
        spark.read.schema(clients).parquet(f"{path}/by_client"),
        spark.read.schema("book_id bigint, n bigint").parquet(f"{path}/by_book"),
    )
