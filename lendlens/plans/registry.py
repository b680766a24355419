"""Named queries over the retail test tables, one per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lendlens.functions import text
from lendlens.functions.dates import days_overdue, parse_iso
from lendlens.operators import audits, ingest, intake, paging, queries, reports, totals
from lendlens.operators.predicates import BookSearch, ClientSearch, LoanSearch
from lendlens.plans import batches
from lendlens.session import shared_folder, staged
from lendlens.sinks import exports
from lendlens.sources import retail
from lendlens.sources.library import (
    BOOK,
    BOOK_COLS,
    CLIENT,
    CLIENT_COLS,
    LOAN,
    Library,
    flat_books,
    flat_clients,
    flat_loans,
    read_library,
    write_library,
)
from lendlens.sources.upgrades import backfill_address, backfill_due_dates

Query = Callable[[SparkSession, str], DataFrame]

DAY = date(1997, 1, 1)
LATE_DAY = date(2000, 12, 1)

BOOK_SEARCH = BookSearch(name="RING", author="brand#1", genre="a_", year_min=1955, year_max=1990)
CLIENT_SEARCH = ClientSearch(name="customer#00000_0")
LOAN_SEARCH = LoanSearch(
    client_name="CUSTOMER",
    book_name="e%t",
    genre="M",
    year_min=1960,
    start_min=date(1996, 1, 1),
    start_max=date(2000, 6, 30),
)


Source = Callable[[SparkSession, str], Library]


def written_snapshot(spark: SparkSession, sf_dir: str) -> Library:
    """The library of these tables, written to the shared folder and read back."""
    path = f"{shared_folder(spark).rstrip('/')}/library-{uuid.uuid4().hex}"
    write_library(retail.library(spark, sf_dir), path)
    return read_library(spark, path)


def _lines(df: DataFrame, key: list[str], line: Column) -> DataFrame:
    return df.select(*key, line.alias("line"))


def _table_rows(library: Library) -> DataFrame:
    """Every row of the three tables as (table, id, row)."""

    def rows(name: str, df: DataFrame, schema: StructType) -> DataFrame:
        texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in schema.names]
        return df.select(F.lit(name).alias("table"), "id", F.concat_ws("|", *texts).alias("row"))

    return (
        rows("book", library.books, BOOK)
        .unionByName(rows("client", library.clients, CLIENT))
        .unionByName(rows("loan", library.loans, LOAN))
    )


def _spot(address: str) -> tuple[float, float]:
    """A geocoder that needs no service: the address's length and last character."""
    return float(len(address)), float(ord(address[-1]))


def _iso_dates(library: Library) -> DataFrame:
    day = text.iso(F.col("start_date"))
    return library.loans.select("id", day.alias("day"), parse_iso(day).alias("parsed"))


def _days_overdue(library: Library) -> DataFrame:
    days = days_overdue(F.col("end_date"), F.col("return_date"), F.lit(LATE_DAY))
    return library.loans.select("id", days.alias("days"))


def _quoted(library: Library) -> DataFrame:
    titled = F.concat(F.lit('The "'), "name", F.lit('"'))
    return library.books.select(
        "id", text.escape_quotes(titled).alias("escaped"), text.quoted(titled).alias("quoted")
    )


def _report_lines(library: Library) -> DataFrame:
    """The lines of the four text reports, with the report's name."""

    def named(report: str, df: DataFrame, line: Column) -> DataFrame:
        return df.select(F.lit(report).alias("report"), line.alias("line"))

    loans = text.client_line(F.col("loans"))
    return (
        named("total", reports.total_loans_per_client(library), loans)
        .unionByName(named("open", reports.unreturned_loans_per_client(library), loans))
        .unionByName(
            named(
                "visit",
                reports.last_visit_dates(library),
                text.client_line(text.iso(F.col("last_visit"))),
            )
        )
        .unionByName(named("genre", reports.genre_scores(library), text.genre_line()))
    )


def _by_title(library: Library) -> tuple[DataFrame, list[str]]:
    return flat_books(library).select(*BOOK_COLS), ["book_name", "book_id"]


def _all_loans(library: Library) -> tuple[DataFrame, list]:
    rows = queries.loan_rows(library, flat_loans(library), None).select("loan_id", "book_name")
    return rows, ["book_name", "loan_id"]


def _decisions(operation: Callable[[Library, DataFrame], ingest.Outcome]):
    """Every row of the batch with its final ID and the reason it was refused."""

    def rows(library: Library, changes: DataFrame) -> DataFrame:
        outcome = operation(library, changes)
        accepted = outcome.accepted.withColumn("reason", F.lit(None).cast("string"))
        both = accepted.unionByName(outcome.rejected, allowMissingColumns=True)
        return both.select("arrival", "id", "reason")

    return rows


def _audit_of_load(library: Library, unchecked: DataFrame) -> DataFrame:
    unchecked = staged(unchecked)  # read with the library after the load and for its IDs
    after = batches.with_unchecked(library, unchecked)
    return audits.audit_change(library, after, **batches.unchecked_ids(library, unchecked))


def _kept_totals(library: Library) -> totals.Totals:
    """The totals of the library, written to the shared folder and read back."""
    spark = library.loans.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/totals-{uuid.uuid4().hex}"
    totals.write_totals(totals.count_loans(library.loans), path)
    return totals.read_totals(spark, path)


def _after_append(report: Callable[..., DataFrame]):
    """A report after a batch of new loans, from the totals kept and the accepted rows alone."""

    def rows(library: Library, new_loans: DataFrame) -> DataFrame:
        outcome = ingest.append_loans(library, new_loans)
        return report(library, totals=totals.after_append(_kept_totals(library), outcome.accepted))

    return rows


def _after_delete(report: Callable[..., DataFrame]):
    """A report after items were deleted, their loans with them, from the totals kept and the loans gone."""

    def rows(library: Library, ids: DataFrame) -> DataFrame:
        outcome = ingest.delete_books(library, ids)
        after = outcome.library
        items = outcome.accepted.select(F.col("id").alias("book_id"))
        gone = library.loans.join(items, "book_id", "left_semi").select(*LOAN.names)
        kept = totals.after_change(_kept_totals(library), gone, gone.limit(0), after.loans)
        return report(after, totals=kept)

    return rows


def queries_over(source: Source, several: Source | None = None) -> dict[str, Query]:
    """The named queries, each over the library that ``source`` gives.

    ``several`` gives the same library to those that read the loans more than once, where ``source`` works them out anew
    each time.
    """
    several = several or source

    def _of_library(query: Callable[[Library], DataFrame]) -> Query:
        return lambda spark, sf_dir: query(source(spark, sf_dir))

    def _of_damaged(query: Callable[[Library], DataFrame]) -> Query:
        return lambda spark, sf_dir: query(retail.damaged(source(spark, sf_dir)))

    def _with_batch(
        query: Callable[[Library, DataFrame], DataFrame], batch: Query, read: Source = source
    ) -> Query:
        return lambda spark, sf_dir: query(read(spark, sf_dir), batch(spark, sf_dir))

    def _with_loans_of(
        query: Callable[[Library, DataFrame], DataFrame], batch: Callable[[DataFrame], DataFrame]
    ) -> Query:
        def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
            library = several(spark, sf_dir)
            return query(library, batch(library.loans))

        return rows

    def _after(operation, table: str) -> Callable[[Library, DataFrame], DataFrame]:
        return lambda lib, changes: getattr(operation(lib, changes).library, table)

    def _table_after(operation, batch: Query, table: str) -> Query:
        return _with_batch(_after(operation, table), batch)

    sources_and_sinks: dict[str, Query] = {
        "read_library": lambda s, d: _table_rows(written_snapshot(s, d)),
        "backfill_due_dates": lambda s, d: backfill_due_dates(retail.old_loans(s, d)),
        "backfill_address": lambda s, d: backfill_address(retail.old_clients(s, d)),
        "export_overdue_tsv": _of_library(lambda lib: exports.overdue_tsv_lines(lib, LATE_DAY)),
        "export_overdue_tsv_damaged": _of_damaged(lambda lib: exports.overdue_tsv_lines(lib, LATE_DAY)),
        "geocode_by_function": _of_library(lambda lib: exports.places_from(lib, _spot)),
        "export_loans_geojson": _with_batch(exports.geojson_lines, batches.places),
        "export_loans_geojson_stub": _of_library(
            lambda lib: exports.geojson_lines(lib, exports.stub_places(lib))
        ),
        "geocode": _with_batch(
            lambda lib, places: exports.geocode(flat_clients(lib), places).select(
                "client_id", "address", "lon", "lat"
            ),
            batches.places,
        ),
    }

    searches: dict[str, Query] = {
        "contains_like": _of_library(lambda lib: queries.books(lib, BookSearch(name="D%_NG"))),
        "year_between": _of_library(
            lambda lib: queries.books(lib, BookSearch(year_min=1960, year_max=1975))
        ),
        "start_between": _of_library(
            lambda lib: queries.expired_loans_at(
                lib, LATE_DAY, LoanSearch(start_min=date(1998, 1, 1), start_max=date(1998, 12, 31))
            )
        ),
        "book_search": _of_library(lambda lib: queries.books(lib, BOOK_SEARCH)),
        "client_search": _of_library(lambda lib: queries.clients(lib, CLIENT_SEARCH)),
        "loan_search": _of_library(lambda lib: queries.expired_loans_at(lib, LATE_DAY, LOAN_SEARCH)),
    }

    texts: dict[str, Query] = {
        "book_text": _of_library(lambda lib: _lines(queries.books(lib), ["book_id"], text.book_text())),
        "client_text": _of_library(
            lambda lib: _lines(queries.clients(lib), ["client_id"], text.client_text())
        ),
        "loan_text": _of_library(
            lambda lib: _lines(
                queries.loan_rows(lib, queries.flat_loans(lib), None), ["loan_id"], text.loan_text()
            )
        ),
        "history_text": _of_library(
            lambda lib: _lines(queries.book_history(lib), ["loan_id"], text.history_text())
        ),
        "overdue_text": _of_library(
            lambda lib: _lines(queries.expired_loans_at(lib, DAY), ["loan_id"], text.overdue_text())
        ),
        "report_lines": _of_library(_report_lines),
        "days_overdue": _of_library(_days_overdue),
        "escape_quotes": _of_library(_quoted),
        "iso_date": _of_library(_iso_dates),
    }

    rows: dict[str, Query] = {
        "books": _of_library(queries.books),
        "clients": _of_library(queries.clients),
        "unloaned_books_at": _of_library(lambda lib: queries.unloaned_books_at(lib, DAY)),
        "unloaned_books_at_search": _of_library(
            lambda lib: queries.unloaned_books_at(lib, LATE_DAY, BookSearch(genre="large"))
        ),
        "unreturned_loans": _of_library(queries.unreturned_loans),
        "expired_loans_at": _of_library(lambda lib: queries.expired_loans_at(lib, LATE_DAY)),
        "book_history": _of_library(queries.book_history),
        "books_loaned_during": _with_batch(queries.books_loaned_during, retail.requests),
    }

    per_client: dict[str, Query] = {
        "genre_scores": _of_library(reports.genre_scores),
        "last_visit_dates": _of_library(reports.last_visit_dates),
        "total_loans_per_client": _of_library(reports.total_loans_per_client),
        "unreturned_loans_per_client": _of_library(reports.unreturned_loans_per_client),
        "unreturned_loans_per_client_all": _of_library(
            lambda lib: reports.unreturned_loans_per_client(lib, keep_all=True)
        ),
        "genre_scores_after_append": _with_batch(_after_append(reports.genre_scores), batches.new_loans, several),
        "last_visit_dates_after_append": _with_batch(_after_append(reports.last_visit_dates), batches.new_loans, several),
        "total_loans_after_append": _with_batch(_after_append(reports.total_loans_per_client), batches.new_loans, several),
        "unreturned_loans_after_append": _with_batch(
            _after_append(reports.unreturned_loans_per_client), batches.new_loans, several
        ),
        "last_visit_dates_after_delete": _with_batch(
            _after_delete(reports.last_visit_dates), batches.discarded_books, several
        ),
        "total_loans_after_delete": _with_batch(
            _after_delete(reports.total_loans_per_client), batches.discarded_books, several
        ),
        "count_rows": _of_library(
            lambda lib: reports.count_rows(queries.expired_loans_at(lib, LATE_DAY))
        ),
        "count_distinct_genre": _of_library(reports.count_distinct_genre),
    }

    pages: dict[str, Query] = {
        "page": _of_library(lambda lib: paging.page(*_by_title(lib), start=20, count=10)),
        "page_after": _of_library(
            lambda lib: paging.page_after(*_by_title(lib), last_key=["new bolt", 100], count=10)
        ),
        "row_at": _of_library(lambda lib: paging.row_at(*_by_title(lib), position=42)),
        "page_deep": _of_library(lambda lib: paging.page(*_all_loans(lib), start=5000, count=25)),
        "row_at_deep": _of_library(lambda lib: paging.row_at(*_all_loans(lib), position=5432)),
        "sliced": _of_library(lambda lib: paging.sliced(*_all_loans(lib), part=slice(-4000, -50, 700))),
        "order_by": _of_library(
            lambda lib: flat_clients(lib).select(*CLIENT_COLS).orderBy("address", F.desc("client_id"))
        ),
        "row_number": _of_library(lambda lib: paging.numbered(*_all_loans(lib))),
        "every_nth": _of_library(lambda lib: paging.every_nth(*_by_title(lib), step=7, start=3)),
        "page_count": _of_library(lambda lib: paging.page_count(queries.unreturned_loans(lib))),
    }

    rules: dict[str, Query] = {
        "overlap_violations": _of_library(audits.overlap_violations),
        "overlap_violations_as_written": _of_library(
            lambda lib: audits.overlap_violations(lib, as_written=True)
        ),
        "loan_before_book": _of_library(audits.loan_before_book),
        "loan_before_client": _of_library(audits.loan_before_client),
        "book_after_loan": _with_batch(
            lambda lib, changes: audits.book_after_loan(lib, changes.select("id", "added")),
            batches.book_changes,
        ),
        "client_after_loan": _with_batch(
            lambda lib, changes: audits.client_after_loan(lib, changes.select("id", "registered")),
            batches.client_changes,
        ),
        "return_before_start": _of_damaged(audits.return_before_start),
        "due_before_start": _of_damaged(audits.due_before_start),
        "null_required": _of_damaged(audits.null_required),
        "orphan_loans": _of_damaged(audits.orphan_loans),
        "duplicate_ids": _of_damaged(audits.duplicate_ids),
        "audit_all": lambda s, d: audits.audit_all(retail.damaged(several(s, d))),
        "audit_change": _with_batch(_audit_of_load, batches.unchecked_loans, several),
    }

    batch: dict[str, Query] = {
        "clean_rows": lambda s, d: intake.clean_rows(batches.raw_books(s, d), BOOK),
        "append_books": _with_batch(_decisions(ingest.append_books), batches.new_books),
        "append_books_table": _table_after(ingest.append_books, batches.new_books, "books"),
        "append_clients": _with_batch(_decisions(ingest.append_clients), batches.new_clients),
        "append_clients_table": _table_after(ingest.append_clients, batches.new_clients, "clients"),
        "append_loans": _with_batch(_decisions(ingest.append_loans), batches.new_loans, several),
        "append_loans_table": _with_batch(_after(ingest.append_loans, "loans"), batches.new_loans, several),
        "update_books": _table_after(ingest.update_books, batches.book_changes, "books"),
        "update_books_decisions": _with_batch(_decisions(ingest.update_books), batches.book_changes),
        "update_clients": _table_after(ingest.update_clients, batches.client_changes, "clients"),
        "update_clients_decisions": _with_batch(_decisions(ingest.update_clients), batches.client_changes),
        "update_loans": _with_loans_of(_decisions(ingest.update_loans), batches.loan_changes),
        "update_loans_table": _with_loans_of(_after(ingest.update_loans, "loans"), batches.loan_changes),
        "record_returns": _with_loans_of(_decisions(ingest.record_returns), batches.returns),
        "record_returns_table": _with_loans_of(_after(ingest.record_returns, "loans"), batches.returns),
        "delete_books": _table_after(ingest.delete_books, batches.discarded_books, "loans"),
        "delete_books_table": _table_after(ingest.delete_books, batches.discarded_books, "books"),
        "delete_books_decisions": _with_batch(_decisions(ingest.delete_books), batches.discarded_books),
        "delete_clients": _table_after(ingest.delete_clients, batches.leaving_clients, "loans"),
        "delete_clients_table": _table_after(ingest.delete_clients, batches.leaving_clients, "clients"),
        "delete_clients_decisions": _with_batch(_decisions(ingest.delete_clients), batches.leaving_clients),
        "check_loan_requests": _with_batch(ingest.check_loan_requests, retail.requests),
    }

    return {
        **sources_and_sinks,
        **searches,
        **texts,
        **rows,
        **per_client,
        **pages,
        **rules,
        **batch,
    }


ALL: dict[str, Query] = queries_over(retail.library, retail.library_once)
