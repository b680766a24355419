"""Batches of new and changed rows, worked out from the whole retail tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.sources import retail
from lendlens.sources.library import LOAN, Library


def raw_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as typed in: text columns with stray spaces and bad values."""
    size = F.col("year") - 1950
    books = retail.books(spark, sf_dir)
    return books.select(
        F.col("id").alias("arrival"),
        F.when(size % 7 != 0, F.col("id").cast("string")).alias("id"),
        F.when(size == 13, F.lit(" \t "))
        .otherwise(F.concat(F.lit("\t "), "name", F.lit("  ")))
        .alias("name"),
        F.when(size == 21, F.lit("12a"))
        .when(size == 22, F.lit("19_72"))
        .when(size == 23, F.lit("1973.0"))
        .otherwise(F.concat(F.lit(" "), F.col("year").cast("string")))
        .alias("year"),
        F.when(size != 17, F.col("author")).alias("author"),
        "genre",
        F.when(size == 31, F.lit("2024-02-30"))
        .when(size == 32, F.lit("2024-1-2"))
        .when(size == 33, F.lit("20240102"))
        .when(size == 34, F.lit("2024-W10-1"))
        .when(size == 35, F.lit("2023W53"))
        .otherwise(F.date_format("added", "yyyy-MM-dd"))
        .alias("added"),
    )


def _new_id(kind: Column, beyond: Column) -> Column:
    """Some IDs already in use, some given twice in the batch, the rest unset."""
    paired = F.floor(F.col("id") / 2).cast("bigint") + beyond
    return F.when(kind == 0, F.col("id")).when(kind == 1, paired)


def new_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retail.books(spark, sf_dir).select(
        F.col("id").alias("arrival"),
        _new_id(F.col("year") % 4, retail.beyond(spark, sf_dir, "part")).alias("id"),
        F.when(F.col("year") != 1994, F.col("name")).alias("name"),
        "year",
        "author",
        "genre",
        "added",
    )


def new_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.dayofmonth("registered") % 4
    return retail.clients(spark, sf_dir).select(
        F.col("id").alias("arrival"),
        _new_id(kind, retail.beyond(spark, sf_dir, "customer")).alias("id"),
        "name",
        "registered",
        F.when(F.col("address") != "NATION_3", F.col("address")).alias("address"),
    )


def new_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loan per request, back after up to six days or not at all."""
    term = F.datediff("last_day", "first_day")
    back = F.date_add("first_day", (F.lit(42) - term))
    return retail.requests(spark, sf_dir).select(
        F.col("request_id").alias("arrival"),
        F.lit(None).cast("bigint").alias("id"),
        F.col("first_day").alias("start_date"),
        F.col("last_day").alias("end_date"),
        F.when(F.dayofmonth("first_day") != 31, back).alias("return_date"),
        "book_id",
        "client_id",
    )


def book_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retail.books(spark, sf_dir).select(
        F.col("id").alias("arrival"),
        F.when(F.col("year") == 1977, F.col("id") + retail.beyond(spark, sf_dir, "part"))
        .otherwise(F.col("id"))
        .alias("id"),
        F.upper("name").alias("name"),
        "year",
        F.when(F.col("year") != 1978, F.col("author")).alias("author"),
        "genre",
        F.date_add("added", (F.col("year") - 1970) * 5).alias("added"),
    )


def client_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retail.clients(spark, sf_dir).select(
        F.col("id").alias("arrival"),
        "id",
        F.concat("name", F.lit(" *")).alias("name"),
        F.date_add("registered", F.dayofmonth("registered") * 9).alias("registered"),
        F.lower("address").alias("address"),
    )


def loan_changes(loans: DataFrame) -> DataFrame:
    """Every loan cut to at most four days, the open ones given a return."""
    shortest = F.date_add("start_date", F.dayofmonth("start_date") % 5)
    return loans.select(
        F.col("id").alias("arrival"),
        "id",
        "start_date",
        F.date_add("end_date", 3).alias("end_date"),
        F.least(F.coalesce("return_date", shortest), shortest).alias("return_date"),
        "book_id",
        "client_id",
    )


def returns(loans: DataFrame) -> DataFrame:
    """A return for every loan; only those still out can take it."""
    return loans.select(
        F.col("id").alias("arrival"),
        "id",
        F.when(F.dayofmonth("end_date") == 1, F.date_sub("start_date", 1))
        .otherwise(F.date_sub("end_date", 5))
        .alias("return_date"),
    )


def discarded_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item is named; those not of the seventies under an unknown ID."""
    stays = ~F.col("year").between(1970, 1979)
    unknown = F.col("id") + retail.beyond(spark, sf_dir, "part")
    return retail.books(spark, sf_dir).select(
        F.col("id").alias("arrival"),
        F.when(stays, unknown).otherwise(F.col("id")).alias("id"),
    )


def leaving_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    stays = F.col("registered") >= F.lit(date(1994, 9, 1))
    unknown = F.col("id") + retail.beyond(spark, sf_dir, "customer")
    return retail.clients(spark, sf_dir).select(
        F.col("id").alias("arrival"),
        F.when(stays, unknown).otherwise(F.col("id")).alias("id"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates by address; one address in five has none."""
    nation = retail.table(spark, sf_dir, "nation")
    lon = F.col("n_nationkey").cast("double") * 5 - 60.5
    lat = F.when(F.col("n_regionkey") != 4, F.col("n_regionkey").cast("double") * 10)
    return nation.select(F.col("n_name").alias("address"), lon.alias("lon"), lat.alias("lat"))


def _added_again() -> Column:
    return F.col("year") == 1960


def _unregistered() -> Column:
    return F.col("address") == "NATION_3"


def unchecked_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of new loans under IDs of its own, loaded past all checks."""
    return new_loans(spark, sf_dir).withColumn("id", -F.col("arrival")).select(*LOAN.names)


def with_unchecked(library: Library, unchecked: DataFrame) -> Library:
    """The library after a load past all checks: more loans, items entered again later, borrowers without a day."""
    again = library.books.filter(_added_again()).withColumn("added", F.date_add("added", 700))
    registered = F.when(~_unregistered(), F.col("registered"))
    return Library(
        library.books.unionByName(again),
        library.clients.withColumn("registered", registered),
        library.loans.select(*LOAN.names).unionByName(unchecked),
    )


def unchecked_ids(library: Library, unchecked: DataFrame) -> dict[str, DataFrame]:
    """The IDs that such a load names, by table."""
    return {
        "books": library.books.filter(_added_again()).select("id"),
        "clients": library.clients.filter(_unregistered()).select("id"),
        "loans": unchecked.select("id"),
    }
