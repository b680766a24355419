"""Search predicates: optional terms, ANDed, over the flat report columns."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.functions.text import contains_like


def between(column: str, low, high) -> list[Column]:
    """Inclusive range, each end optional."""
    terms = []
    if low is not None:
        terms.append(F.col(column) >= F.lit(low))
    if high is not None:
        terms.append(F.col(column) <= F.lit(high))
    return terms


def contains(column: str, value: str | None) -> list[Column]:
    return [] if value is None else [contains_like(F.col(f"{column}_key"), value)]


def all_of(terms: list[Column]) -> Column:
    """AND of the given terms; none given means no filter."""
    return reduce(and_, terms, F.lit(True))


def apply(df: DataFrame, search: BookSearch | ClientSearch | LoanSearch | None) -> DataFrame:
    terms = search.terms() if search is not None else []
    return df.filter(all_of(terms)) if terms else df


def _check_text(**texts: str | None) -> None:
    for name, value in texts.items():
        if value is not None and (not value or value != value.strip()):
            raise ValueError(f"{name} must be trimmed and not empty: {value!r}")


def _check_range(name: str, low, high) -> None:
    if low is not None and high is not None and low > high:
        raise ValueError(f"{name}: {low} is above {high}")


@dataclass(frozen=True)
class BookSearch:
    name: str | None = None
    author: str | None = None
    genre: str | None = None
    year_min: int | None = None
    year_max: int | None = None

    def __post_init__(self) -> None:
        _check_text(name=self.name, author=self.author, genre=self.genre)
        _check_range("year", self.year_min, self.year_max)

    def terms(self) -> list[Column]:
        return [
            *contains("book_name", self.name),
            *contains("author", self.author),
            *contains("genre", self.genre),
            *between("year", self.year_min, self.year_max),
        ]


@dataclass(frozen=True)
class ClientSearch:
    name: str | None = None

    def __post_init__(self) -> None:
        _check_text(name=self.name)

    def terms(self) -> list[Column]:
        return contains("client_name", self.name)


@dataclass(frozen=True)
class LoanSearch:
    client_name: str | None = None
    book_name: str | None = None
    author: str | None = None
    genre: str | None = None
    year_min: int | None = None
    year_max: int | None = None
    start_min: date | None = None
    start_max: date | None = None

    def __post_init__(self) -> None:
        _check_text(
            client_name=self.client_name,
            book_name=self.book_name,
            author=self.author,
            genre=self.genre,
        )
        _check_range("year", self.year_min, self.year_max)
        _check_range("start", self.start_min, self.start_max)

    def book_terms(self) -> list[Column]:
        return [
            *contains("book_name", self.book_name),
            *contains("author", self.author),
            *contains("genre", self.genre),
            *between("year", self.year_min, self.year_max),
        ]

    def client_terms(self) -> list[Column]:
        return contains("client_name", self.client_name)

    def loan_terms(self) -> list[Column]:
        return between("start_date", self.start_min, self.start_max)

    def terms(self) -> list[Column]:
        return [*self.client_terms(), *self.book_terms(), *self.loan_terms()]
