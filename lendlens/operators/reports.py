"""Aggregated reports. Loans are counted by key first, then joined.

With ``totals``, kept from before (``operators/totals.py``), the loans are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.operators.predicates import ClientSearch, apply
from lendlens.operators.totals import Totals
from lendlens.sources.library import CLIENT_COLS, Library, flat_books, flat_clients


def genre_scores(library: Library, totals: Totals | None = None) -> DataFrame:
    """Loans per folded genre, genres without loans included.

    The label of a group is its smallest spelling.
    """
    per_book = totals.by_book if totals else library.loans.groupBy("book_id").agg(F.count("*").alias("n"))
    books = flat_books(library).join(per_book, "book_id", "left")
    spellings = books.groupBy("genre_key", "genre").agg(F.sum("n").alias("n"))
    return (
        spellings.groupBy("genre_key")
        .agg(F.min("genre").alias("genre"), F.coalesce(F.sum("n"), F.lit(0)).alias("score"))
        .orderBy(F.desc("score"), "genre_key")
        .select("genre", "score")
    )


def _with_totals(
    library: Library, search: ClientSearch | None, totals: DataFrame
) -> DataFrame:
    return apply(flat_clients(library), search).join(totals, "client_id", "left")


def _by_name(found: DataFrame, value: Column) -> DataFrame:
    rows = found.select(*CLIENT_COLS, value, "client_name_key")
    return rows.orderBy("client_name_key", "client_id").drop("client_name_key")


def last_visit_dates(
    library: Library, search: ClientSearch | None = None, totals: Totals | None = None
) -> DataFrame:
    """Latest return (or start, while out) per borrower, else the registration day."""
    seen = F.max(F.coalesce("return_date", "start_date")).alias("seen")
    per_client = totals.by_client if totals else library.loans.groupBy("client_id").agg(seen)
    found = _with_totals(library, search, per_client)
    return _by_name(found, F.coalesce("seen", "registered").alias("last_visit"))


def total_loans_per_client(
    library: Library, search: ClientSearch | None = None, totals: Totals | None = None
) -> DataFrame:
    n = F.count("*").alias("n")
    per_client = totals.by_client if totals else library.loans.groupBy("client_id").agg(n)
    found = _with_totals(library, search, per_client)
    return _by_name(found, F.coalesce("n", F.lit(0)).alias("loans"))


def unreturned_loans_per_client(
    library: Library,
    search: ClientSearch | None = None,
    keep_all: bool = False,
    totals: Totals | None = None,
) -> DataFrame:
    """Loans still out per borrower.

    A borrower without any loan shows 0, one whose loans are all back is left
    out; ``keep_all`` shows that borrower with 0 too.
    """
    is_open = F.col("return_date").isNull()
    loans = library.loans.filter(is_open) if keep_all else library.loans
    per_client = (
        totals.by_client.select("client_id", F.col("still_out").alias("n"))
        if totals
        else loans.groupBy("client_id").agg(F.count_if(is_open).alias("n"))
    )
    found = _with_totals(library, search, per_client)
    if not keep_all:
        found = found.filter("n IS NULL OR n > 0")
    return _by_name(found, F.coalesce("n", F.lit(0)).alias("loans"))


def count_rows(df: DataFrame) -> DataFrame:
    """Size of a result, as a one-row table ``n``."""
    return df.agg(F.count("*").alias("n"))


def count_distinct_genre(library: Library) -> DataFrame:
    return flat_books(library).agg(F.count_distinct("genre_key").alias("n"))
