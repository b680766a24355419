"""The three tables: items, borrowers and loans."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendlens.functions.dates import parse_iso
from lendlens.functions.text import fold
from lendlens.sources.upgrades import backfill_address, backfill_due_dates

BOOK = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("author", T.StringType()),
        T.StructField("genre", T.StringType()),
        T.StructField("added", T.DateType()),
    ]
)
CLIENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("registered", T.DateType()),
        T.StructField("address", T.StringType()),
    ]
)
LOAN = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
        T.StructField("return_date", T.DateType()),
        T.StructField("book_id", T.LongType()),
        T.StructField("client_id", T.LongType()),
    ]
)

#: Columns that may be null; every other column of the three tables may not.
NULLABLE = {"return_date"}

#: Searched text columns, kept folded next to the original in a written library.
BOOK_TEXT = ("name", "author", "genre")
CLIENT_TEXT = ("name",)

BOOK_COLS = ["book_id", "book_name", "year", "author", "genre", "added"]
CLIENT_COLS = ["client_id", "client_name", "registered", "address"]
LOAN_COLS = ["loan_id", "start_date", "end_date", "return_date", "book_id", "client_id"]


@dataclass(frozen=True)
class Library:
    """One snapshot of the three tables."""

    books: DataFrame
    clients: DataFrame
    loans: DataFrame

    def with_(self, **tables: DataFrame) -> Library:
        return replace(self, **tables)


def month_key(day: Column) -> Column:
    """The month by which a store lays out its loans."""
    return F.date_format(day, "yyyy-MM")


def out_now(loans: DataFrame) -> DataFrame:
    """Loans still out; of a store, only their folders."""
    rows = loans.filter(F.col("return_date").isNull())
    return rows.filter("open_key") if "open_key" in loans.columns else rows


def begun_by(loans: DataFrame, day: Column) -> DataFrame:
    """Loans begun by a day; of a store, only the folders of the months up to it."""
    rows = loans.filter(F.col("start_date") <= day)
    return rows.filter(F.col("month_key") <= month_key(day)) if "month_key" in loans.columns else rows


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and type the columns of ``schema``.

    A text date that is no ISO date stops the job with its value: a return day
    lost on the way would turn a returned loan into an open one.
    """
    present = dict(df.dtypes)

    def typed(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DateType) and present[field.name] == "string":
            day = parse_iso(column)
            message = F.concat(F.lit(f"{field.name} is not an ISO date: "), column)
            bad = column.isNotNull() & day.isNull()
            return F.when(bad, F.raise_error(message).cast("date")).otherwise(day).alias(field.name)
        return column.cast(field.dataType).alias(field.name)

    folded = [F.col(name) for name in df.columns if name.endswith("_key")]
    return df.select(*[typed(field) for field in schema], *folded)


def read_library(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schemas: dict[str, str] | None = None,
    **options: str,
) -> Library:
    """Read ``path``/book, /client and /loan in any format Spark reads.

    Snapshots of the older schemas are brought up to the current one. Formats
    without a schema of their own need ``schemas`` by table, else Spark goes
    through the data once more to infer them.
    """

    def raw(name: str) -> DataFrame:
        reader = spark.read.format(fmt).options(**options)
        if schemas:
            reader = reader.schema(schemas[name])
        return reader.load(f"{path}/{name}")

    books, clients, loans = raw("book"), raw("client"), raw("loan")
    if "address" not in clients.columns:
        clients = backfill_address(clients)
    if "end_date" not in loans.columns:
        loans = backfill_due_dates(loans)
    return Library(conform(books, BOOK), conform(clients, CLIENT), conform(loans, LOAN))


def write_library(library: Library, path: str, key_filters: int | None = None) -> None:
    """Write a snapshot to a new place; an existing one is never overwritten.

    Loans still out stand apart from the returned ones, and both lie in order
    of their start, so the statistics of the files rule most of them out for
    the reports of one day; the ID in the range key splits a busy day. Folded
    text columns are stored so that searches push down to the files.

    The order by start puts loans of an item in every file. ``key_filters``, the
    number of distinct items or borrowers to reckon with in a row group, adds
    Bloom filters on both keys, by which the history of one item or borrower
    passes over the row groups that have none of its loans.
    """
    with_keys(library.books, BOOK_TEXT).write.parquet(f"{path}/book")
    with_keys(library.clients, CLIENT_TEXT).write.parquet(f"{path}/client")
    key = [F.col("return_date").isNull(), F.col("start_date"), F.col("id")]
    laid_out = library.loans.repartitionByRange(*key).sortWithinPartitions(*key)
    writer = laid_out.write
    for column in ("book_id", "client_id") if key_filters else ():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(key_filters))
    writer.parquet(f"{path}/loan")


def with_keys(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Add the folded columns that are not stored yet."""
    missing = {f"{n}_key": fold(F.col(n)) for n in names if f"{n}_key" not in df.columns}
    return df.withColumns(missing) if missing else df


def flat_books(library: Library) -> DataFrame:
    """Items under their report names, with the folded search keys."""
    books = with_keys(library.books, BOOK_TEXT)
    return books.select(
        F.col("id").alias("book_id"),
        F.col("name").alias("book_name"),
        "year",
        "author",
        "genre",
        "added",
        F.col("name_key").alias("book_name_key"),
        "author_key",
        "genre_key",
    )


def flat_clients(library: Library) -> DataFrame:
    clients = with_keys(library.clients, CLIENT_TEXT)
    return clients.select(
        F.col("id").alias("client_id"),
        F.col("name").alias("client_name"),
        "registered",
        "address",
        F.col("name_key").alias("client_name_key"),
    )


def flat_loans(library: Library) -> DataFrame:
    return flat(library.loans)


def flat(loans: DataFrame) -> DataFrame:
    return loans.withColumnRenamed("id", "loan_id").select(*LOAN_COLS)
