"""Report files: tab-separated text and GeoJSON.

The lines are sorted across the part files, so the parts joined in name order
are the whole file: one header, and one valid JSON document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.functions.text import book_text, client_text, iso, or_empty, quoted
from lendlens.operators.predicates import LoanSearch
from lendlens.operators.queries import open_loan_rows, overdue_rows
from lendlens.session import staged
from lendlens.sources.library import Library, flat_clients
from lendlens.sources.upgrades import UNKNOWN_ADDRESS

#: Column names of the overdue report file: fixed values of the format.
OVERDUE_HEADER = (
    "BookName",
    "Author",
    "Genre",
    "PublicationYear",
    "ClientName",
    "ClientRegDate",
    "LoanStartDate",
    "LoanEndDate",
    "ExpiredByDays",
)

_ORDER = ["part", "book_name", "loan_id"]


def _fixed_line(df: DataFrame, part: int, text: str) -> DataFrame:
    """A one-row frame for a line that stands before or after the rows."""
    no_key = [F.lit(None).cast("string").alias("book_name"), F.lit(None).cast("long").alias("loan_id")]
    one = df.sparkSession.range(1)
    return one.select(F.lit(part).alias("part"), *no_key, F.lit(text).alias("line"))


def overdue_tsv_lines(
    library: Library, at: date, search: LoanSearch | None = None
) -> DataFrame:
    """Header and rows of the overdue report, in file order, as ``line``."""
    late = overdue_rows(library, at, search)
    empty = F.lit("")
    # Each field stands in its place: a missing value is an empty one, quoted where the others are.
    fields = [
        quoted(F.coalesce("book_name", empty)),
        quoted(F.coalesce("author", empty)),
        quoted(F.coalesce("genre", empty)),
        or_empty(F.col("year")),
        quoted(F.coalesce("client_name", empty)),
        or_empty(iso(F.col("registered"))),
        or_empty(iso(F.col("start_date"))),
        or_empty(iso(F.col("end_date"))),
        or_empty(F.col("days_overdue")),
    ]
    line = F.concat_ws("\t", *fields)
    rows = late.select(F.lit(1).alias("part"), "book_name", "loan_id", line.alias("line"))
    header = _fixed_line(late, 0, "\t".join(OVERDUE_HEADER))
    return header.unionByName(rows).orderBy(*_ORDER).select("line")


def stub_places(library: Library) -> DataFrame:
    """Stand-in for a geocoder: every address at (0, 0), the unknown one nowhere."""
    addresses = library.clients.select("address").distinct()
    known = addresses.filter(F.col("address") != UNKNOWN_ADDRESS)
    zero = F.lit(0).cast("double")
    return known.select("address", zero.alias("lon"), zero.alias("lat"))


def places_from(
    library: Library, geocoder: Callable[[str], tuple[float, float] | None]
) -> DataFrame:
    """Places by a caller's function from an address to (lon, lat) or nothing.

    Each distinct address is looked up once, on the executors.
    """

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spots = [geocoder(address) or (None, None) for address in pdf["address"]]
            yield pdf.assign(lon=[s[0] for s in spots], lat=[s[1] for s in spots])

    addresses = library.clients.select("address").filter("address IS NOT NULL").distinct()
    return addresses.mapInPandas(locate, "address string, lon double, lat double")


def geocode(clients: DataFrame, places: DataFrame) -> DataFrame:
    """Add lon and lat from ``places`` (address, lon, lat), one row per address.

    Borrowers whose address has no coordinates drop out.
    """
    located = places.filter("lon IS NOT NULL AND lat IS NOT NULL")
    return clients.join(located.select("address", "lon", "lat"), "address")


def geojson_lines(
    library: Library, places: DataFrame, search: LoanSearch | None = None
) -> DataFrame:
    """Open loans as one FeatureCollection, a feature per line, as ``line``."""
    located = open_loan_rows(library, search, geocode(flat_clients(library), places))
    feature = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias(
                "geometry"
            ),
            F.struct(book_text().alias("book"), client_text().alias("client")).alias("properties"),
        )
    )
    rows = staged(located.select("book_name", "loan_id", feature.alias("feature")))
    last = rows.agg(F.max(F.struct("book_name", "loan_id")).alias("last"))
    marked = rows.join(
        F.broadcast(last), F.struct("book_name", "loan_id") == F.col("last"), "left"
    )
    comma: Column = F.when(F.col("last").isNull(), F.lit(",")).otherwise(F.lit(""))
    features = marked.select(
        F.lit(1).alias("part"), "book_name", "loan_id", F.concat("feature", comma).alias("line")
    )
    # Fixed values of the format.
    head = _fixed_line(rows, 0, '{"type": "FeatureCollection","features": [')
    tail = _fixed_line(rows, 2, "]}")
    lines = head.unionByName(features).unionByName(tail)
    return lines.orderBy(*_ORDER).select("line")


def write_lines(lines: DataFrame, path: str) -> None:
    """Write the lines to text part files in a new folder, in order.

    ``hadoop fs -getmerge`` (or ``cat`` on part-*) gives the single file.
    """
    lines.write.text(path)


def export_overdue_tsv(
    library: Library, at: date, path: str, search: LoanSearch | None = None
) -> None:
    write_lines(overdue_tsv_lines(library, at, search), path)


def export_loans_geojson(
    library: Library, places: DataFrame, path: str, search: LoanSearch | None = None
) -> None:
    write_lines(geojson_lines(library, places, search), path)
