"""Folding, wildcards, intervals and other rules on small made-up libraries."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lendlens.functions import text
from lendlens.functions.dates import parse_iso
from lendlens.operators import audits, paging, queries, reports
from lendlens.operators.occupancy import overlap_flags
from lendlens.operators.predicates import BookSearch, ClientSearch, LoanSearch
from lendlens.sources.library import flat_books, flat_clients, flat_loans


def book(id, name="b", year=2000, author="a", genre="g", added="2024-01-01"):
    return (id, name, year, author, genre, added)


def client(id, name="c", registered="2024-01-01", address="x"):
    return (id, name, registered, address)


def loan(id, start, returned, book_id=1, client_id=1, due=None):
    return (id, start, due or start, returned, book_id, client_id)


def test_genres_fold_ascii_only(make_library):
    library = make_library(
        [book(i, genre=g) for i, g in enumerate(["drama", "Drama", "DRAMA", "Драма", "драма"])],
        [client(1)],
        [loan(1, "2024-02-01", None, 1), loan(2, "2024-02-01", None, 3)],
    )
    scores = {r["genre"]: r["score"] for r in reports.genre_scores(library).collect()}
    assert scores == {"DRAMA": 1, "Драма": 1, "драма": 0}
    assert reports.count_distinct_genre(library).first()["n"] == 3


@pytest.mark.parametrize(
    ("search", "ids"),
    [
        ("a_b", [1, 2]),
        ("A%B", [1, 2, 3, 4]),
        ("\\", [3]),
        ("a\\_b", [3]),
        ('"', [4]),
        ("ВОЙНА", []),
        ("Война", [5]),
    ],
)
def test_search_wildcards(make_library, search, ids):
    names = ["a_b", "axb", "a\\_b", 'A "q"\tB', "Война"]
    library = make_library([book(i + 1, name=n) for i, n in enumerate(names)])
    found = queries.books(library, BookSearch(name=search))
    assert sorted(r["book_id"] for r in found.collect()) == ids


@pytest.mark.parametrize(
    "make",
    [
        lambda: BookSearch(name=""),
        lambda: BookSearch(author=" a"),
        lambda: BookSearch(year_min=2, year_max=1),
        lambda: ClientSearch(name="a\n"),
        lambda: LoanSearch(start_min=date(2024, 2, 1), start_max=date(2024, 1, 1)),
    ],
)
def test_search_terms_are_checked(make):
    with pytest.raises(ValueError):
        make()


def test_names_sort_folded_titles_binary(make_library):
    library = make_library(
        [book(1, "b"), book(2, "B"), book(3, "a")],
        [client(1, "b"), client(2, "B"), client(3, "a")],
    )
    assert [r["book_id"] for r in queries.books(library).collect()] == [2, 3, 1]
    assert [r["client_id"] for r in queries.clients(library).collect()] == [3, 1, 2]


def test_return_day_under_the_three_conventions(make_library, spark):
    library = make_library(
        [book(1)],
        [client(1)],
        [loan(1, "2024-01-02", "2024-01-05"), loan(2, "2024-01-05", "2024-01-07")],
    )
    only_first = library.with_(loans=library.loans.filter("id = 1"))
    day = date(2024, 1, 5)
    assert queries.unloaned_books_at(only_first, day).count() == 1
    request = spark.createDataFrame(
        [(1, 1, day, day), (2, 1, date(2024, 1, 6), day), (3, 9, day, day)],
        "request_id long, book_id long, first_day date, last_day date",
    )
    flags = queries.books_loaned_during(only_first, request).collect()
    assert [r["loaned"] for r in flags] == [True, False, False]
    assert audits.overlap_violations(library).count() == 0


def test_loans_without_a_start_answer_no_request(make_library, spark):
    library = make_library([book(1)], [client(1)], [loan(1, None, None, due="2024-01-01")])
    day = date(2024, 1, 5)
    request = spark.createDataFrame(
        [(1, 1, day, day)], "request_id long, book_id long, first_day date, last_day date"
    )
    assert not queries.books_loaned_during(library, request).first()["loaned"]


def test_zero_length_loans(make_library):
    spans = [
        (1, "2024-01-01", "2024-01-01", 1),  # alone at its start
        (2, "2024-01-01", "2024-01-01", 1),  # twice there
        (3, "2024-01-01", "2024-01-09", 2),
        (4, "2024-01-05", "2024-01-05", 2),  # strictly inside 3
        (5, "2024-01-01", "2024-01-01", 2),  # same start as 3
        (6, "2024-01-09", "2024-01-09", 2),  # at the end of 3
        (7, "2024-01-01", None, 3),
        (8, "2025-01-01", "2025-01-01", 3),  # inside an open loan
    ]
    loans = [loan(i, s, r, b) for i, s, r, b in spans]
    library = make_library([book(i) for i in (1, 2, 3)], [client(1)], loans)
    flags = overlap_flags(library.loans).collect()
    assert sorted(r["loan_id"] for r in flags) == [3, 4, 7, 8]


def test_returned_loans_collide_only_as_written(make_library):
    library = make_library(
        [book(1), book(2)],
        [client(1)],
        [
            loan(1, "2024-01-01", "2024-01-03"),
            loan(2, "2024-02-01", "2024-02-03"),
            loan(3, "2024-01-01", "2024-01-03", 2),
        ],
    )
    assert audits.overlap_violations(library).count() == 0
    written = audits.overlap_violations(library, as_written=True).collect()
    assert sorted(r["loan_id"] for r in written) == [1, 2]


def test_faults_are_found(make_library):
    library = make_library(
        [book(1), book(2, name=None), book(2), book(3, added="2024-06-01")],
        [client(1), client(4, registered="2024-07-01")],
        [
            loan(1, "2024-03-01", "2024-02-01", due="2024-02-01"),
            loan(2, "2024-03-01", "2024-03-02", book_id=77),
            loan(3, "2024-03-01", "2024-03-02", book_id=3, client_id=88),
            loan(4, "2024-05-01", "2024-05-02", client_id=4),
            loan(5, None, None, book_id=2, due="2024-01-01"),
        ],
    )
    found = sorted((r["rule"], r["table"], r["id"], r["detail"]) for r in audits.audit_all(library).collect())
    assert found == [
        ("due_before_start", "loan", 1, "2024-02-01 < 2024-03-01"),
        ("duplicate_id", "book", 2, "2 rows"),
        ("loan_before_book", "loan", 3, "2024-03-01 < 2024-06-01"),
        ("loan_before_client", "loan", 4, "2024-05-01 < 2024-07-01"),
        ("null_required", "book", 2, "name"),
        ("null_required", "loan", 5, "start_date"),
        ("orphan_loan", "loan", 2, "book_id 77"),
        ("orphan_loan", "loan", 3, "client_id 88"),
        ("return_before_start", "loan", 1, "2024-02-01 < 2024-03-01"),
    ]


def test_strict_iso_dates(spark):
    texts = ["2024-01-02", "20240102", "2024-1-2", "2024-02-30", "2024-01-02 ", "12024-01-02", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    parsed = [r[0] for r in df.select(parse_iso(F.col("t"))).collect()]
    assert parsed == [date(2024, 1, 2), date(2024, 1, 2)] + [None] * 5


def test_pages_rebuild_the_whole(make_library):
    library = make_library([book(i, name=f"n{i % 3}") for i in range(23)])
    books, order = flat_books(library), ["book_name", "book_id"]
    whole = [r["book_id"] for r in books.orderBy(*order).collect()]
    pages = [
        r["book_id"]
        for start in range(0, 30, 10)
        for r in paging.page(books, order, start, 10).collect()
    ]
    assert pages == whole
    keyset, last = [], ["", -1]
    while rows := paging.page_after(books, order, last, 4).collect():
        keyset += [r["book_id"] for r in rows]
        last = [rows[-1]["book_name"], rows[-1]["book_id"]]
    assert keyset == whole
    numbers = {r["row_number"]: r["book_id"] for r in paging.numbered(books, order).collect()}
    assert numbers == dict(enumerate(whole, 1))
    for start, stop, step in [(0, None, 1), (3, None, 7), (2, 11, 4)]:
        rows = paging.every_nth(books, order, step, start, stop).orderBy("row_number").collect()
        assert [r["book_id"] for r in rows] == whole[start:stop:step]
    for part in (slice(-5, None), slice(2, 20, 6), slice(9, 3), slice(None)):
        rows = paging.sliced(books, order, part).collect()
        assert [r["book_id"] for r in rows] == whole[part]
    assert paging.page_count(books).first().asDict() == {"rows": 23, "pages": 3}
    assert [paging.current_page(p, 23) for p in (0, 2, 9)] == [0, 2, 2]
    assert paging.current_page(0, 0) == 0
    assert paging.row_at(books, order, 5).first()["book_id"] == whole[5]
    with pytest.raises(ValueError):
        paging.row_at(books, order, -1)


def test_missing_values_leave_a_line_in_place(make_library):
    nobody = (1, None, None, None)
    library = make_library([(1, None, 2000, None, "g", None)], [nobody], [loan(1, "2024-01-01", None, 1)])
    row = flat_loans(library).join(flat_books(library), "book_id").join(flat_clients(library), "client_id")
    assert row.select(text.loan_text()).first()[0].startswith(" (, 2000 г.) [g] -  [рег: , адрес: ] - c 2024-01-01 по ")


def test_week_dates(spark):
    days = ["2024-W10-1", "2024W10", "2020-W53-7", "2021-W53-1", "2024-W00-1", "2024-W10-8", "2024-W101", "2009W537"]
    found = spark.createDataFrame([(d,) for d in days], "d string").select(parse_iso(F.col("d"))).collect()

    def wanted(text):
        try:
            return date.fromisoformat(text)
        except ValueError:
            return None

    assert [r[0] for r in found] == [wanted(d) for d in days]
    assert sum(r[0] is not None for r in found) == 4
