"""Changes to loans by the way taken for many of them, where changes and loans are dealt by ID once."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ingest import LOAN_BATCH, at, collide, collected, fault, random_loans, reasons, shelf  # noqa: F401
from test_scale import SMALL, plan_of, settings

from lendlens.functions.dates import OPEN_END
from lendlens.operators import ingest, rounds
from lendlens.plans import registry
from lendlens.session import staged_by
from lendlens.sources.library import LOAN


@pytest.fixture
def many(monkeypatch):
    monkeypatch.setattr(ingest, "FEW_CHANGES", 0)


def test_the_loans_are_put_together_without_moving_them(spark, many):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false"):
        plan = plan_of(registry.ALL["update_loans_table"](spark, SMALL))
    assert "Exchange hashpartitioning(loan" in plan
    assert "Exchange hashpartitioning(id" not in plan and "lineitem" not in plan


def test_changes_are_judged_as_one_at_a_time(spark, shelf, many):  # noqa: F811
    rng = random.Random(6)
    books, clients, before = collected(shelf)
    ids = [r[0] for r in before] + [999, None]
    batch = random_loans(rng, 40, lambda arrival: rng.choice(ids))
    after, expected, good = {r[0]: r for r in before}, {}, {}
    for arrival, *rest in sorted(batch):
        row = tuple(rest)
        known = {None: "null id", 999: "unmatched"}
        expected[arrival] = known[row[0]] if row[0] in known else fault(row, books, clients)
        if expected[arrival] is None:
            good[arrival] = row
    moving = {row[0] for row in good.values()}
    for arrival, row in good.items():
        met = [i for i, other in after.items() if i != row[0] and collide(row, other)]
        if met:
            expected[arrival] = "overlaps a loan" if any(i not in moving for i in met) else "overlaps the batch"
        else:
            after[row[0]] = row
    outcome = ingest.update_loans(shelf, spark.createDataFrame(batch, LOAN_BATCH))
    assert reasons(outcome) == expected
    assert {r["id"]: tuple(r) for r in outcome.library.loans.select(*LOAN.names).collect()} == after


@pytest.mark.parametrize("limit", [0, 100])
def test_loans_on_several_rows_and_without_an_id(spark, make_library, monkeypatch, limit):
    monkeypatch.setattr(ingest, "FEW_CHANGES", limit)
    day = [str(at(n)) for n in range(60)]
    held = [
        (1, day[1], day[3], day[3], 1, 1),
        (2, day[5], day[8], day[8], 1, 1),
        (2, day[5], day[8], day[8], 1, 1),
        (None, day[20], day[25], day[25], 1, 1),
        (3, day[30], day[33], day[33], 1, 1),
        (4, day[40], day[43], day[43], 1, 1),
        (5, day[50], day[53], None, 2, 1),
    ]
    books = [(1, "n", 2000, "a", "g", day[0]), (2, "n", 2000, "a", "g", day[0])]
    library = make_library(books, [(1, "c", day[0], "x")], held)
    changes = [
        (1, 1, at(21), at(22), at(22), 1, 1),  # meets the loan without an ID
        (2, 2, at(9), at(10), at(10), 1, 1),
        (3, 3, at(2), at(4), at(4), 1, 1),  # loan 1 has stayed
        (4, 4, at(41), at(42), at(42), 1, 7),
        (5, None, at(41), at(42), at(42), 1, 1),
        (6, 9, at(41), at(42), at(42), 1, 1),
    ]
    outcome = ingest.update_loans(library, spark.createDataFrame(changes, LOAN_BATCH))
    assert reasons(outcome) == {
        1: "overlaps a loan",
        2: None,
        3: "overlaps the batch",
        4: "unknown client",
        5: "null id",
        6: "unmatched",
    }
    moved = (2, at(9), at(10), at(10), 1, 1)
    expected = [tuple(r) for r in library.loans.filter("id IS NULL OR id <> 2").collect()] + [moved, moved]
    found = [tuple(r) for r in outcome.library.loans.select(*LOAN.names).collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected))


def test_changes_that_fit_send_nothing_back(spark, monkeypatch):
    n = F.col("loan")
    first = F.date_add(F.lit(date(2024, 1, 1)), (n * 10).cast("int"))
    batch = spark.range(50).withColumnRenamed("id", "loan").select(
        n.alias("arrival"),
        "loan",
        F.lit(1).cast("long").alias("book_id"),
        first.alias("first"),
        F.date_add(first, 2).alias("last"),
        F.lit(False).alias("is_return"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(1).cast("long").alias("held_book"),
        first.alias("held_first"),
        F.date_add(first, 5).alias("held_last"),
    )
    told = []
    judge = rounds._verdicts

    def watched(dealt):
        found = judge(dealt)
        told.append(found.count())
        return found

    monkeypatch.setattr(rounds, "_verdicts", watched)
    none = batch.select("book_id", "first", "last").limit(0)
    assert rounds.settle(batch, none).filter("reason IS NULL").count() == 50
    assert told == [0]


def test_days_travel_whole(spark):
    days = [date(1, 1, 1), date(1969, 12, 31), date(1970, 1, 1), date(2024, 2, 29), OPEN_END]
    since = [(d - date(1970, 1, 1)).days for d in days]
    rng = random.Random(1)
    rows = [
        (i, rng.randrange(99), 2, i, -i - 1, *(rng.choice(since) for _ in range(4)), i % 2 == 0, i % 3 == 0, rng.choice([1, 10**6]), f)
        for i, f in enumerate([0, 1, 15, 32, 63] * 10)
    ]
    names = "item long, cell int, kind int, arrival long, loan long, first int, last int, own_first int, own_last int"
    dealt = spark.createDataFrame(rows, f"{names}, new_here boolean, own_here boolean, cells int, flags int")
    packed = rounds._packed(dealt).orderBy("arrival").collect()
    found = rounds._unpacked({c: np.array([r[c] for r in packed]) for c in rounds._ROW})
    for place, name in enumerate(dealt.columns):
        if name not in ("item", "cell"):
            assert found[name].tolist() == [r[place] for r in rows], name


def test_rows_by_key_are_not_dealt_again(spark):
    rows = spark.range(1000).select((F.col("id") % 300).alias("id"), F.col("id").alias("n"))
    kept = staged_by(rows, "id")
    assert sorted(kept.collect()) == sorted(rows.collect())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("staged_")]
    with settings(spark, spark__sql__adaptive__enabled="false"):
        assert "Exchange" not in plan_of(kept.groupBy("id").agg(F.max("n")))
