"""A library built from the retail test tables, and batches of changes for it.

Parts play items, customers borrowers and order lines loans. Every row of the
tables is used. Keys are mapped so that some items and borrowers have no loan:
the lines of every 17th part and every 10th customer go to its neighbour.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.session import staged
from lendlens.sources.library import Library

#: Loans of lines flagged "N" in orders from this day on have not come back.
RECENT = date(2000, 6, 1)


#: Columns read from the tables; named here so that no job has to look them up.
SCHEMAS = {
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
    "customer": "c_custkey long, c_name string, c_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, "
    "l_returnflag string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def beyond(spark: SparkSession, sf_dir: str, name: str) -> Column:
    """One more than the largest key of part or customer, 1 if there is none."""
    key = {"part": "p_partkey", "customer": "c_custkey"}[name]
    top = table(spark, sf_dir, name).agg(F.coalesce(F.max(key), F.lit(0)) + 1)
    return top.scalar()


def _neighbour(key: str, every: int) -> Column:
    moved = (F.col(key) % every == 0) & (F.col(key) > 0)
    return F.when(moved, F.col(key) - 1).otherwise(F.col(key))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelling = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.lower("p_type"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        (F.col("p_size") + 1950).alias("year"),
        F.col("p_brand").alias("author"),
        spelling.alias("genre"),
        F.date_add(F.lit(date(1995, 1, 1)), (F.col("p_partkey") % 365).cast("int")).alias("added"),
    )


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer = table(spark, sf_dir, "customer")
    registered = F.date_add(F.lit(date(1994, 6, 1)), (F.col("c_custkey") % 400).cast("int"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        registered.alias("registered"),
        F.col("n_name").alias("address"),
    )


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Dealt by order, the lines travel once for their groups and for the join.
    lines = (
        table(spark, sf_dir, "lineitem")
        .repartition("l_orderkey")
        .groupBy("l_orderkey", _neighbour("l_partkey", 17).alias("book_id"))
        .agg(
            F.max("l_quantity").cast("int").alias("held"),
            # As a number, for a hash aggregate instead of a sort.
            F.min(F.ascii("l_returnflag")).alias("flag"),
            F.min("l_linenumber").alias("line"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("start_date"),
        _neighbour("o_custkey", 10).alias("client_id"),
    )
    still_out = (F.col("flag") == ord("N")) & (F.col("start_date") >= F.lit(RECENT))
    returned = F.when(~still_out, F.date_add("start_date", F.col("held")))
    # A pair of keys as one number: no two pairs share it, whatever the number of parts.
    pair = F.col("l_orderkey") * beyond(spark, sf_dir, "part") + F.col("book_id")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        pair.alias("id"),
        "start_date",
        F.date_add("start_date", F.col("line") * 7).alias("end_date"),
        returned.alias("return_date"),
        "book_id",
        "client_id",
    )


def library(spark: SparkSession, sf_dir: str) -> Library:
    return Library(books(spark, sf_dir), clients(spark, sf_dir), loans(spark, sf_dir))


def library_once(spark: SparkSession, sf_dir: str) -> Library:
    """The library with its loans worked out once and written, for jobs that read them several times."""
    whole = library(spark, sf_dir)
    return whole.with_(loans=staged(whole.loans))


def old_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loans as the first schema kept them: without a due date."""
    return loans(spark, sf_dir).drop("end_date")


def old_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clients(spark, sf_dir).drop("address")


def damaged(whole: Library) -> Library:
    """The library with faults for the audits, in rows picked by their values."""
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("year") == 1960, 2).otherwise(1)))
    bad_books = whole.books.select(
        "*", copies.alias("copy")
    ).select(
        "id",
        "name",
        "year",
        F.when(F.col("author") != "Brand#7", F.col("author")).alias("author"),
        "genre",
        "added",
    )
    bad_clients = whole.clients.withColumn(
        "registered", F.when(F.col("address") != "NATION_3", F.col("registered"))
    )
    term = F.datediff("end_date", "start_date")
    bad_loans = whole.loans.select(
        "id",
        F.when(F.col("start_date") != F.lit(date(1996, 2, 29)), F.col("start_date")).alias("start_date"),
        F.when(F.dayofmonth("start_date") == 13, F.date_sub("start_date", 2))
        .otherwise(F.col("end_date"))
        .alias("end_date"),
        F.when((F.dayofweek("start_date") == 6) & (term == 28), F.date_sub("start_date", 1))
        .otherwise(F.col("return_date"))
        .alias("return_date"),
        F.when(F.col("book_id") % 50 == 7, -F.col("book_id")).otherwise(F.col("book_id")).alias("book_id"),
        F.when(F.col("client_id") % 50 == 9, -F.col("client_id"))
        .otherwise(F.col("client_id"))
        .alias("client_id"),
    )
    return Library(bad_books, bad_clients, bad_loans)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One loan request per order: its lowest part, from its first ship date."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_partkey").alias("book_id"),
            F.to_date(F.min("l_shipdate")).alias("first_day"),
            F.max("l_linenumber").alias("line"),
        )
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("request_id"),
        "book_id",
        F.col("o_custkey").alias("client_id"),
        "first_day",
        F.date_add("first_day", F.col("line") * 7).alias("last_day"),
    )
