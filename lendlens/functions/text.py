"""Text expressions: ASCII case folding, LIKE search and the report lines.

The wording of the report lines is a set of fixed values of the report format.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)


def fold(text: Column) -> Column:
    """Case-fold the 26 ASCII letters and nothing else.

    ``lower()`` and the lower-case collations also fold Cyrillic, which must
    stay case-sensitive here.
    """
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def contains_like(folded: Column, value: str) -> Column:
    """``LIKE '%value%'`` on an already folded column.

    ``%`` and ``_`` inside the value stay wildcards. A backslash is an ordinary
    character, so it is doubled to get past Spark's default escape.
    """
    pattern = value.translate(_TO_LOWER).replace("\\", "\\\\")
    return folded.like(f"%{pattern}%")


def escape_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('""'))


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), escape_quotes(text), F.lit('"'))


def or_empty(text: Column) -> Column:
    """A missing value of a report line as nothing, so that the rest of the line stays in place."""
    return F.coalesce(text.cast("string"), F.lit(""))


def iso(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def book_text() -> Column:
    """``Name (Author, Year г.) [Genre]`` from the flat book columns."""
    values = [or_empty(F.col(c)) for c in ("book_name", "author", "year", "genre")]
    return F.format_string("%s (%s, %s г.) [%s]", *values)


def client_text() -> Column:
    """``Name [рег: date, адрес: address]`` from the flat client columns."""
    values = [or_empty(x) for x in (F.col("client_name"), iso(F.col("registered")), F.col("address"))]
    return F.format_string("%s [рег: %s, адрес: %s]", *values)


def loan_text() -> Column:
    """Book, borrower and term; the return date is added once there is one.

    The word before the start date is a Latin ``c`` here and a Cyrillic one in
    ``history_text``: both are fixed values of the report format.
    """
    returned = F.concat(F.lit(" - Дата возврата "), iso(F.col("return_date")))
    return F.concat(
        book_text(),
        F.lit(" - "),
        client_text(),
        F.lit(" - c "),
        or_empty(iso(F.col("start_date"))),
        F.lit(" по "),
        or_empty(iso(F.col("end_date"))),
        or_empty(returned),
    )


def history_text() -> Column:
    """One line of an item's history: borrower, start and, once known, return."""
    returned = F.concat(F.lit(" по "), iso(F.col("return_date")))
    return F.concat(
        client_text(), F.lit(" - с "), or_empty(iso(F.col("start_date"))), or_empty(returned)
    )


def overdue_text() -> Column:
    return F.concat(
        loan_text(), F.lit(" - "), or_empty(F.col("days_overdue")), F.lit(" дней.")
    )


def client_line(value: Column) -> Column:
    """``client - value`` for the per-borrower reports."""
    return F.concat(client_text(), F.lit(" - "), or_empty(value))


def genre_line() -> Column:
    return F.concat(or_empty(F.col("genre")), F.lit(" - "), or_empty(F.col("score")))
