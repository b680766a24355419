"""Row-returning queries over one library snapshot."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.functions.dates import days_overdue, is_overdue, out_on
from lendlens.operators.occupancy import furthest_return
from lendlens.operators.predicates import BookSearch, ClientSearch, LoanSearch, all_of, apply
from lendlens.operators.sizing import narrowed
from lendlens.session import staged
from lendlens.sources.library import (
    BOOK_COLS,
    CLIENT_COLS,
    LOAN_COLS,
    Library,
    begun_by,
    flat,
    flat_books,
    flat_clients,
    flat_loans,
    out_now,
)

LOAN_ROW = LOAN_COLS + [c for c in BOOK_COLS + CLIENT_COLS if c not in LOAN_COLS]


def books(library: Library, search: BookSearch | None = None) -> DataFrame:
    found = apply(flat_books(library), search)
    return found.select(*BOOK_COLS).orderBy("book_name", "book_id")


def clients(library: Library, search: ClientSearch | None = None) -> DataFrame:
    found = apply(flat_clients(library), search)
    return found.orderBy("client_name_key", "client_id").select(*CLIENT_COLS)


def unloaned_books_at(
    library: Library, day: date, search: BookSearch | None = None
) -> DataFrame:
    """Items in stock on ``day`` and not out that day.

    The items out are reduced to distinct IDs first, so an item with a huge
    number of loans is one row when the anti join shuffles.
    """
    at = F.lit(day)
    begun = begun_by(library.loans, at)
    out = begun.filter(out_on(F.col("start_date"), F.col("return_date"), at))
    in_stock = apply(flat_books(library), search).filter(F.col("added") <= at)
    free = in_stock.join(out.select("book_id").distinct(), "book_id", "left_anti")
    return free.select(*BOOK_COLS).orderBy("book_name", "book_id")


def loan_rows(
    library: Library, loans: DataFrame, search: LoanSearch | None, clients: DataFrame | None = None
) -> DataFrame:
    """Loans found, with their item and borrower; orphans fall out.

    The search comes before the joins: the keys of the items and borrowers it
    finds narrow the loans, and only the loans found meet the wide rows.
    """
    people = flat_clients(library) if clients is None else clients
    items = flat_books(library)
    if search is not None:
        loans = loans.filter(all_of(search.loan_terms()))
        if terms := search.book_terms():
            items = items.filter(all_of(terms))
            loans = narrowed(loans, items, "book_id")
        if terms := search.client_terms():
            people = people.filter(all_of(terms))
            loans = narrowed(loans, people, "client_id")
    return loans.join(items, "book_id").join(people, "client_id")


def open_loan_rows(
    library: Library, search: LoanSearch | None = None, clients: DataFrame | None = None
) -> DataFrame:
    return loan_rows(library, flat(out_now(library.loans)), search, clients)


def overdue_rows(library: Library, at: date, search: LoanSearch | None = None) -> DataFrame:
    day = F.lit(at)
    due, returned = F.col("end_date"), F.col("return_date")
    late = flat_loans(library).filter(is_overdue(due, returned, day))
    rows = loan_rows(library, late, search)
    return rows.withColumn("days_overdue", days_overdue(due, returned, day))


def unreturned_loans(library: Library, search: LoanSearch | None = None) -> DataFrame:
    return open_loan_rows(library, search).select(*LOAN_ROW).orderBy("book_name", "loan_id")


def expired_loans_at(
    library: Library, at: date, search: LoanSearch | None = None
) -> DataFrame:
    """Loans past due at ``at`` with the whole days they are or were late."""
    rows = overdue_rows(library, at, search).select(*LOAN_ROW, "days_overdue")
    return rows.orderBy("book_name", "loan_id")


def book_history(library: Library, book_ids: DataFrame | int | None = None) -> DataFrame:
    """Loans of one item, of the items in ``book_ids`` (column book_id) or of all."""
    loans = flat_loans(library)
    order = ["book_id", "start_date", "loan_id"]
    if isinstance(book_ids, int):
        loans, order = loans.filter(F.col("book_id") == book_ids), order[1:]
    elif book_ids is not None:
        loans = loans.join(book_ids.select("book_id").distinct(), "book_id", "left_semi")
    columns = LOAN_COLS + [c for c in CLIENT_COLS if c not in LOAN_COLS]
    return loans.join(flat_clients(library), "client_id").select(*columns).orderBy(*order)


def books_loaned_during(library: Library, requests: DataFrame) -> DataFrame:
    """Flag each request (request_id, book_id, first_day, last_day): is the item out?

    The range is closed at both ends and so is the loan, return day included.
    """
    requests = staged(requests)  # read three times
    reach = furthest_return(library.loans, requests.select("book_id", "last_day"))
    day = F.coalesce(F.col("reach") >= F.col("first_day"), F.lit(False))
    return (
        requests.join(reach, ["book_id", "last_day"], "left")
        .select(*requests.columns, day.alias("loaned"))
        .orderBy("request_id")
    )
