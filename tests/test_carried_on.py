"""Totals and audits carried on with a change, against the same worked out from the whole library."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lendlens.operators import reports
from lendlens.operators.audits import audit_all, audit_change
from lendlens.operators.totals import after_append, after_change, count_loans, read_totals, write_totals
from lendlens.sources.library import LOAN


def some_loan(rng, i):
    first = rng.randrange(1, 25)
    back = rng.choice([None, first - 1, first, first + 2, first + 5])
    days = [f"2024-05-{d + 1:02d}" if d is not None else None for d in (first, first + rng.randrange(-1, 4), back)]
    if rng.random() < 0.05:
        days[rng.randrange(2)] = None
    return (i, *days, rng.choice([1, 2, 3, 4, 9, None]), rng.choice([1, 2, 3, 8, None]))


def some_parent(rng, i, book):
    day = rng.choice([f"2024-05-{rng.randrange(1, 28):02d}", "2024-01-01", "2024-01-01", None])
    return (i, "a", 1990, "b", rng.choice(["c", "C", "d"]), day) if book else (i, rng.choice(["n", None]), day, "s")


def changed(rng, rows, new_row):
    """Rows after some went, some changed, some came (one of them under an ID in use), and the IDs of all these."""
    hit = [r for r in rows if rng.random() < 0.2]
    kept = [r for r in rows if r not in hit]
    put = [new_row(rng, r[0]) for r in hit if rng.random() < 0.6]
    come = [new_row(rng, i) for i in (rng.choice(rows)[0], 50, None)[: rng.randrange(4)]]
    return kept + put + come, [(r[0],) for r in hit + come]


def counted(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", range(2))
def test_audit_of_a_change_is_the_audit_after_less_that_before(spark, make_library, seed):
    rng = random.Random(seed)
    tables = [
        ([some_parent(rng, i, True) for i in (1, 2, 3, 4, 4)], lambda r, i: some_parent(r, i, True)),
        ([some_parent(rng, i, False) for i in (1, 2, 3)], lambda r, i: some_parent(r, i, False)),
        ([some_loan(rng, i) for i in [*range(30), None]], some_loan),
    ]
    after, ids = zip(*[changed(rng, rows, new) for rows, new in tables], strict=True)
    old, new = make_library(*[rows for rows, _ in tables]), make_library(*after)
    named = [spark.createDataFrame(i, "id bigint") for i in ids]
    expected = counted(audit_all(new)) - counted(audit_all(old))
    assert expected and counted(audit_change(old, new, *named)) == expected


def test_no_change_no_findings(make_library, spark):
    library = make_library(loans=[(1, "2024-05-03", "2024-05-01", None, 7, 7)] * 2)
    assert audit_change(library, library).count() == 0
    assert audit_change(library, library, loans=spark.createDataFrame([(1,)], "id bigint")).count() == 0


def same(totals, loans):
    whole = count_loans(loans)
    assert counted(totals.by_client.select("client_id", "n", "still_out", "seen")) == counted(whole.by_client)
    assert counted(totals.by_book.select("book_id", "n")) == counted(whole.by_book)


@pytest.mark.parametrize("seed", range(2))
def test_totals_after_changes(spark, make_library, tmp_path, seed):
    rng = random.Random(seed)
    rows = [some_loan(rng, i) for i in range(40)]
    library = make_library(loans=rows)
    write_totals(count_loans(library.loans), str(tmp_path / "totals"))
    held = read_totals(spark, str(tmp_path / "totals"))
    more = make_library(loans=[some_loan(rng, i) for i in range(40, 55)]).loans
    loans = library.loans.unionByName(more)
    held = after_append(held, more)
    same(held, loans)
    same(after_append(held, more.limit(0)), loans)
    gone = loans.filter("id % 3 = 0")
    come = make_library(loans=[some_loan(rng, i) for i in range(0, 30, 3)]).loans
    now = loans.filter("id % 3 <> 0").unionByName(come)
    held = after_change(held, gone, come, now)
    same(held, now)
    same(after_change(held, now, now.limit(0), now.limit(0)), now.limit(0))


def test_reports_from_totals_do_not_read_the_loans(golden, spark):
    totals = count_loans(golden.loans)
    kept = type(totals)(*[spark.createDataFrame(df.collect(), df.schema) for df in (totals.by_client, totals.by_book)])
    no_loans = golden.with_(loans=golden.loans.select(*LOAN.names, F.lit(None).alias("never")).drop(*LOAN.names))
    for report in (reports.genre_scores, reports.last_visit_dates, reports.total_loans_per_client):
        assert report(no_loans, totals=kept).collect() == report(golden).collect()
    for keep_all in (False, True):
        found = reports.unreturned_loans_per_client(golden, keep_all=keep_all, totals=kept)
        assert found.collect() == reports.unreturned_loans_per_client(golden, keep_all=keep_all).collect()
