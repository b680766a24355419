"""Answers on the small library of FIXTURES.md."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lendlens.functions import text
from lendlens.operators import audits, queries, reports
from lendlens.operators.predicates import BookSearch, ClientSearch, LoanSearch


def column(df, name):
    return [row[name] for row in df.collect()]


@pytest.mark.parametrize(
    ("at", "free"),
    [
        ("2021-04-01", [14, 11, 12]),
        ("2021-04-15", [14, 11]),
        ("2021-05-20", [10, 14, 11, 15, 12]),
        ("2021-05-25", [10, 14, 11, 15]),
        ("2021-07-05", [10, 14, 12]),
    ],
)
def test_unloaned_books(golden, at, free):
    found = queries.unloaned_books_at(golden, date.fromisoformat(at))
    assert column(found, "book_id") == free


@pytest.mark.parametrize(
    ("at", "late"),
    [
        ("2021-05-03", []),
        ("2021-05-07", [(302, 1), (303, 4)]),
        ("2021-06-10", [(302, 14), (307, 1), (303, 17)]),
        ("2021-07-20", [(302, 14), (308, 18), (307, 41), (303, 17), (305, 16)]),
    ],
)
def test_expired_loans(golden, at, late):
    found = queries.expired_loans_at(golden, date.fromisoformat(at))
    rows = [(r["loan_id"], r["days_overdue"]) for r in found.collect()]
    assert rows == late


def test_open_loans_and_history(golden):
    assert column(queries.unreturned_loans(golden), "loan_id") == [307, 305]
    assert column(queries.unreturned_loans(golden, LoanSearch(author="Дымов")), "loan_id") == [305]
    assert column(queries.book_history(golden, 12), "loan_id") == [303, 304]
    assert column(queries.book_history(golden, 14), "loan_id") == []
    asked = golden.books.select(F.col("id").alias("book_id")).filter("book_id > 11")
    assert column(queries.book_history(golden, asked), "loan_id") == [303, 304, 305, 306, 307]


def test_searches(golden):
    def found(**terms):
        return column(queries.books(golden, BookSearch(**terms)), "book_id")

    assert found() == [10, 14, 11, 15, 12, 13]
    assert found(year_min=1954, year_max=1962) == [10, 12, 13]
    assert found(genre="TRAV") == [10, 11]
    assert found(genre="овесть") == [12, 13]
    assert found(genre="повесть") == [13]
    assert found(name="100%") == [15]
    assert column(queries.clients(golden, ClientSearch("N")), "client_id") == [24, 21]
    assert column(queries.clients(golden, ClientSearch("сафин")), "client_id") == []


def test_reports(golden):
    scores = [tuple(r) for r in reports.genre_scores(golden).collect()]
    assert scores == [("Travel", 3), ("Essay", 2), ("Повесть", 2), ("повесть", 1), ("Atlas", 0)]
    visits = reports.last_visit_dates(golden)
    assert [(r["client_id"], str(r["last_visit"])) for r in visits.collect()] == [
        (23, "2021-07-01"),
        (24, "2021-06-20"),
        (21, "2021-07-10"),
        (22, "2021-05-26"),
    ]

    def loans(df):
        return [(r["client_id"], r["loans"]) for r in df.collect()]

    assert loans(reports.total_loans_per_client(golden)) == [(23, 0), (24, 2), (21, 3), (22, 3)]
    assert loans(reports.unreturned_loans_per_client(golden)) == [(23, 0), (24, 1), (22, 1)]
    kept = reports.unreturned_loans_per_client(golden, keep_all=True)
    assert loans(kept) == [(23, 0), (24, 1), (21, 0), (22, 1)]
    assert reports.count_distinct_genre(golden).first()["n"] == 5
    assert reports.count_rows(queries.unreturned_loans(golden)).first()["n"] == 2


def test_clean_library_has_no_findings(golden):
    assert audits.audit_all(golden).collect() == []


def test_report_texts(golden):
    at = date(2021, 7, 20)
    late = queries.expired_loans_at(golden, at).filter("loan_id = 302")
    assert late.select(text.overdue_text()).first()[0] == (
        "The Gull's Log (M. Osei, 1962 г.) [Travel] - Тимур Сафин "
        "[рег: 2021-03-10, адрес: Озёрный пер., 9, Уфа] - c 2021-04-15 по 2021-05-06 "
        "- Дата возврата 2021-05-20 - 14 дней."
    )
    still_out = queries.unreturned_loans(golden).filter("loan_id = 307")
    assert still_out.select(text.loan_text()).first()[0].endswith("- c 2021-05-26 по 2021-06-09")
    history = queries.book_history(golden, 12).select(text.history_text()).first()[0]
    assert history.endswith("Kalmar] - с 2021-04-03 по 2021-05-20")
    open_history = queries.book_history(golden, 13).select(text.history_text()).first()[0]
    assert open_history.endswith("- с 2021-06-20")
