"""Batches against a row-at-a-time model, and the cleaning of raw rows."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lendlens.operators import audits, ingest
from lendlens.operators.intake import clean_rows
from lendlens.sources.library import BOOK, LOAN

EPOCH = date(2024, 1, 1)
LOAN_BATCH = (
    "arrival long, id long, start_date date, end_date date, return_date date, "
    "book_id long, client_id long"
)


def at(n: int | None) -> date | None:
    return None if n is None else EPOCH + timedelta(n)


def reasons(outcome) -> dict[int, str | None]:
    rows = {r["arrival"]: None for r in outcome.accepted.collect()}
    rejected = {r["arrival"]: r["reason"] for r in outcome.rejected.collect()}
    assert not rows.keys() & rejected.keys()
    return rows | rejected


def span(loan) -> tuple[date, date]:
    return loan[1], loan[3] or date(9999, 12, 31)


def collide(a, b) -> bool:
    (a_first, a_last), (b_first, b_last) = span(a), span(b)
    return a[4] == b[4] and a_first < b_last and b_first < a_last


@pytest.fixture(scope="module")
def shelf(make_library):
    """Three items, two borrowers; the third item and second borrower come late."""
    rng = random.Random(7)
    loans, n = [], 100
    for item in (1, 2):
        start = 5
        for _ in range(6):
            start += rng.randint(0, 9)
            length = rng.randint(0, 6)
            loans.append((n, str(at(start)), str(at(start)), str(at(start + length)), item, 1))
            start, n = start + length, n + 1
    loans.append((n, str(at(70)), str(at(72)), None, 2, 1))
    return make_library(
        [(i, "n", 2000, "a", "g", str(at(40 if i == 3 else 0))) for i in (1, 2, 3)],
        [(1, "c", str(at(0)), "x"), (2, "d", str(at(30)), "y")],
        loans,
    )


def random_loans(rng: random.Random, count: int, ids) -> list[tuple]:
    rows = []
    for arrival in range(count):
        start = rng.randint(0, 80)
        back = rng.choice([None, *[start + n for n in (-1, 0, 0, 1, 2, 3, 5, 8)]])
        due = start + rng.randint(-1, 9)
        item, borrower = rng.choice([1, 1, 1, 2, 3, 9]), rng.choice([1, 1, 2, 8])
        rows.append((arrival, ids(arrival), at(start), at(due), at(back), item, borrower))
    rng.shuffle(rows)
    return rows


def fault(row, books, clients) -> str | None:
    _, start, due, back, item, borrower = row
    if due < start:
        return "due before start"
    if back is not None and back < start:
        return "return before start"
    if item not in books:
        return "unknown book"
    if borrower not in clients:
        return "unknown client"
    if start < books[item]:
        return "before book"
    return "before client" if start < clients[borrower] else None


def collected(library):
    books = {r["id"]: r["added"] for r in library.books.collect()}
    clients = {r["id"]: r["registered"] for r in library.clients.collect()}
    return books, clients, [tuple(r) for r in library.loans.collect()]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_append_loans_first_arrival_wins(spark, shelf, seed):
    rng = random.Random(seed)
    batch = random_loans(rng, 120, lambda arrival: None)
    books, clients, held = collected(shelf)
    before, expected, top = list(held), {}, max(r[0] for r in held)
    for arrival, _, *rest in sorted(batch):
        row = (None, *rest)
        reason = fault(row, books, clients)
        if reason is None and any(collide(row, other) for other in before):
            reason = "overlaps a loan"
        if reason is None and any(collide(row, other) for other in held):
            reason = "overlaps the batch"
        expected[arrival] = reason
        if reason is None:
            top += 1
            held.append((top, *rest))
    outcome = ingest.append_loans(shelf, spark.createDataFrame(batch, LOAN_BATCH))
    assert reasons(outcome) == expected
    assert sorted(map(str, (tuple(r) for r in outcome.library.loans.collect()))) == sorted(
        map(str, held)
    )
    assert {"overlaps a loan", "overlaps the batch", None} <= set(expected.values())
    assert audits.audit_all(outcome.library).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_update_loans(spark, shelf, seed):
    rng = random.Random(seed)
    books, clients, before = collected(shelf)
    ids = [r[0] for r in before] + [999, None]
    batch = random_loans(rng, 40, lambda arrival: rng.choice(ids))
    after, expected, good = {r[0]: r for r in before}, {}, {}
    for arrival, *rest in sorted(batch):
        row = tuple(rest)
        if row[0] is None:
            reason = "null id"
        elif row[0] == 999:
            reason = "unmatched"
        else:
            reason = fault(row, books, clients)
        expected[arrival] = reason
        if reason is None:
            good[arrival] = row
    moving = {row[0] for row in good.values()}
    for arrival, row in good.items():
        met = [i for i, other in after.items() if i != row[0] and collide(row, other)]
        if not met:
            after[row[0]] = row
        else:
            fixed = any(i not in moving for i in met)
            expected[arrival] = "overlaps a loan" if fixed else "overlaps the batch"
    outcome = ingest.update_loans(shelf, spark.createDataFrame(batch, LOAN_BATCH))
    assert reasons(outcome) == expected
    found = {r["id"]: tuple(r) for r in outcome.library.loans.select(*LOAN.names).collect()}
    assert found == after
    assert audits.overlap_violations(outcome.library).count() == 0


def test_changes_see_the_ones_before_them(spark, shelf):
    # Loan 1 leaves its days and loan 2 takes them; then loan 1 changes once more.
    books, clients, before = collected(shelf)
    book, borrower = next(b for b in books), next(c for c in clients)
    free = max(r[1] for r in before)

    def days(n):
        return free + timedelta(days=n)

    start = [(1, None, days(100), days(110), days(110), book, borrower), (2, None, days(200), days(210), days(210), book, borrower)]
    library = ingest.append_loans(shelf, spark.createDataFrame(start, LOAN_BATCH))
    one, two = (r["id"] for r in library.accepted.orderBy("arrival").collect())
    changes = [
        (1, one, days(300), days(310), days(310), book, borrower),
        (2, two, days(102), days(109), days(109), book, borrower),
        (3, one, days(110), days(120), days(120), book, borrower),
        (4, one, days(105), days(108), days(108), book, borrower),
    ]
    outcome = ingest.update_loans(library.library, spark.createDataFrame(changes, LOAN_BATCH))
    assert reasons(outcome) == {1: None, 2: None, 3: None, 4: "overlaps the batch"}
    found = {r["id"]: r["start_date"] for r in outcome.library.loans.filter(F.col("id").isin(one, two)).collect()}
    assert found == {one: days(110), two: days(102)}


def test_record_returns(spark, shelf):
    still_out = shelf.loans.filter("return_date IS NULL").first()["id"]
    rows = [(1, still_out, at(75)), (2, 100, at(75)), (3, 999, at(75)), (4, None, at(75))]
    rows.append((5, still_out, None))
    outcome = ingest.record_returns(
        shelf, spark.createDataFrame(rows, "arrival long, id long, return_date date")
    )
    assert reasons(outcome) == {
        1: None,
        2: "not out",
        3: "unmatched",
        4: "null id",
        5: "null return_date",
    }
    found = outcome.library.loans.filter(F.col("id") == still_out).first()
    assert found["return_date"] == at(75)
    assert outcome.library.loans.count() == shelf.loans.count()


def test_append_assigns_ids_in_arrival_order(spark, shelf):
    rows = [
        (5, None, "e", 2000, "a", "g", at(0)),
        (1, None, "d", 2000, "a", "g", at(0)),
        (2, 1, "taken", 2000, "a", "g", at(0)),
        (3, 7, "given", 2000, "a", "g", at(0)),
        (4, 7, "again", 2000, "a", "g", at(0)),
        (6, 8, None, 2000, "a", "g", at(0)),
    ]
    schema = "arrival long, id long, name string, year int, author string, genre string, added date"
    outcome = ingest.append_books(shelf, spark.createDataFrame(rows, schema))
    assert reasons(outcome) == {1: None, 2: "id taken", 3: None, 4: "id taken", 5: None, 6: "null name"}
    new = {r["id"]: r["name"] for r in outcome.library.books.filter("id > 3").collect()}
    assert new == {7: "given", 8: "d", 9: "e"}


def test_append_to_an_empty_table(spark, make_library):
    rows = [(1, None, "c", at(0), "x"), (2, None, "d", at(0), "y")]
    schema = "arrival long, id long, name string, registered date, address string"
    outcome = ingest.append_clients(make_library(), spark.createDataFrame(rows, schema))
    assert {r["id"]: r["name"] for r in outcome.library.clients.collect()} == {1: "c", 2: "d"}


def test_update_books_keeps_the_last_good_change(spark, shelf):
    rows = [
        (1, 1, "first", 2000, "a", "g", at(0)),
        (2, 1, "second", 2001, "b", "h", at(1)),
        (3, 1, "late", 2000, "a", "g", at(60)),
        (4, 9, "nobody", 2000, "a", "g", at(0)),
        (5, None, "null", 2000, "a", "g", at(0)),
    ]
    schema = "arrival long, id long, name string, year int, author string, genre string, added date"
    outcome = ingest.update_books(shelf, spark.createDataFrame(rows, schema))
    assert reasons(outcome) == {1: None, 2: None, 3: "after a loan", 4: "unmatched", 5: "null id"}
    changed = outcome.library.books.filter("id = 1").first()
    assert tuple(changed) == (1, "second", 2001, "b", "h", at(1))
    assert outcome.library.books.count() == 3


def test_update_clients(spark, shelf):
    rows = [(1, 1, "c2", at(90), "x"), (2, 2, "d2", at(31), "z")]
    schema = "arrival long, id long, name string, registered date, address string"
    outcome = ingest.update_clients(shelf, spark.createDataFrame(rows, schema))
    assert reasons(outcome) == {1: "after a loan", 2: None}
    assert outcome.library.clients.filter("id = 2").first()["address"] == "z"


def test_deletes_cascade(spark, shelf):
    ids = spark.createDataFrame([(1, 1), (2, 1), (3, 9), (4, None)], "arrival long, id long")
    books = ingest.delete_books(shelf, ids)
    assert reasons(books) == {1: None, 2: None, 3: "unmatched", 4: "null id"}
    assert {r["book_id"] for r in books.library.loans.select("book_id").distinct().collect()} == {2}
    assert books.library.books.count() == 2
    clients = ingest.delete_clients(shelf, ids)
    assert clients.library.loans.count() == 0 and clients.library.clients.count() == 1


def test_requests_are_decided(spark, shelf):
    rows = [
        (1, 3, 1, 39, 45),
        (2, 3, 2, 41, 45),
        (3, 2, 1, 80, 81),
        (4, 3, 2, 20, 25),
        (5, 9, 1, 1, 1),
        (6, 3, 9, 50, 50),
        (7, 1, 2, 1, 2),
    ]
    requests = spark.createDataFrame(
        [(r, b, c, at(s), at(e)) for r, b, c, s, e in rows],
        "request_id long, book_id long, client_id long, first_day date, last_day date",
    )
    decided = ingest.check_loan_requests(shelf, requests).collect()
    assert [r["reason"] for r in decided] == [
        "not in stock",
        None,
        "loaned",
        "not in stock",
        "unknown book",
        "unknown client",
        "not registered",
    ]
    assert [r["accepted"] for r in decided] == [r["reason"] is None for r in decided]


def test_clean_rows(spark):
    good = dict(id="7", name="  x  \t", year=" 1_950 ", author="a", genre="g", added="2024-01-02")
    cases = [
        ({}, None),
        ({"id": None}, None),
        ({"id": "7x"}, "bad id"),
        ({"name": " \x1c\n "}, "empty name"),
        ({"author": None}, "empty author"),
        ({"year": "12a"}, "bad year"),
        ({"year": "1950.0"}, "bad year"),
        ({"year": "99999999999"}, "bad year"),
        ({"year": None}, "bad year"),
        ({"added": "2024-1-2"}, "bad added"),
        ({"added": "2024-02-30"}, "bad added"),
        ({"name": "", "added": "x"}, "empty name"),
    ]
    rows = [(n, *(good | change).values()) for n, (change, _) in enumerate(cases)]
    schema = "arrival long, id string, name string, year string, author string, genre string, added string"
    found = clean_rows(spark.createDataFrame(rows, schema), BOOK).orderBy("arrival").collect()
    assert [r["reject_reason"] for r in found] == [reason for _, reason in cases]
    first = found[0]
    assert (first["id"], first["name"], first["year"]) == (7, "x", 1950)
    assert first["added"] == date(2024, 1, 2)
