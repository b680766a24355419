"""A library in versions: what a write touches, and what a broken one leaves."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from lendlens.operators import audits, ingest, queries
from lendlens.sources import store
from lendlens.sources.library import LOAN, Library

MONTHS = 6


@pytest.fixture
def shop(spark, tmp_path, make_library):
    loans = [
        (i, f"2023-{1 + i % MONTHS:02d}-{1 + i:02d}", f"2023-{1 + i % MONTHS:02d}-28", f"2023-{1 + i % MONTHS:02d}-28" if i % 4 else None, i % 20, 1)
        for i in range(24)
    ]
    books = [(i, f"n{i}", 2000, "a", "g", "2022-01-01") for i in range(20)]
    library = make_library(books, [(1, "c", "2022-01-01", "x")], loans)
    path = str(tmp_path / "shop")
    assert store.create(library, path) == 1
    return path, library


def rows(library: Library):
    return [sorted(map(str, df.select(*s.names).collect())) for df, s in zip((library.books, library.clients, library.loans), store.SCHEMAS.values())]


def test_round_trip(spark, shop):
    path, library = shop
    assert rows(store.read_version(spark, path)) == rows(library)
    assert audits.null_required(store.read_version(spark, path)).count() == 0
    with pytest.raises(store.Conflict):
        store.create(library, path)


def test_an_append_leaves_the_files_that_are_there(spark, shop):
    path, library = shop
    before = store._folders(spark, path, 1)
    new = library.loans.limit(2).withColumn("id", F.col("id") + 1000)
    assert store.append(path, "loan", new) == 2
    after = store._folders(spark, path, 2)
    assert set(before["loan"]) < set(after["loan"]) and after["book"] == before["book"]
    assert store.read_version(spark, path).loans.count() == 26
    assert store.read_version(spark, path, 1).loans.count() == 24


def test_a_change_writes_the_months_it_is_in(spark, shop):
    path, library = shop
    back = library.loans.filter("id = 4").withColumn("return_date", F.lit(date(2023, 6, 1)))
    assert store.replace(path, "loan", back, spark.createDataFrame([(8,)], "id long")) == 2
    before, after = (set(store._folders(spark, path, v)["loan"]) for v in (1, 2))
    gone = before - after
    assert {f.split("/", 3)[3] for f in gone} == {f"open_key=true/month_key=2023-{1 + i % MONTHS:02d}" for i in (4, 8)}
    found = {r["id"]: r["return_date"] for r in store.read_version(spark, path).loans.collect()}
    assert found[4] == date(2023, 6, 1) and 8 not in found and len(found) == 23
    store.replace(path, "book", library.books.limit(1).withColumn("name", F.lit("new")))
    assert store.read_version(spark, path).books.filter("name = 'new'").count() == 1


def test_a_broken_write_leaves_the_version_before(spark, shop):
    path, library = shop
    bad = library.loans.withColumn("book_id", F.when(F.col("id") == 3, F.raise_error(F.lit("broken")).cast("long")).otherwise(1))
    with pytest.raises(Exception, match="broken"):
        store.append(path, "loan", bad)
    assert store.versions(spark, path) == [1]
    assert rows(store.read_version(spark, path)) == rows(library)


def test_two_writers_do_not_make_one_version(spark, shop):
    path, _ = shop
    tables = store._folders(spark, path, 1)
    store._publish(spark, path, 2, tables)
    with pytest.raises(store.Conflict):
        store._publish(spark, path, 2, tables)


def test_a_report_of_one_day_opens_its_folders(spark, shop):
    path, library = shop
    again = store.read_version(spark, path)
    day = date(2023, 2, 20)
    found = queries.unloaned_books_at(again, day)
    assert found.collect() == queries.unloaned_books_at(library, day).collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_key" in plan
    still_out = queries.unreturned_loans(again)
    assert still_out.collect() == queries.unreturned_loans(library).collect()
    assert "open_key" in still_out._jdf.queryExecution().executedPlan().toString()


def test_batches_on_a_store(spark, shop):
    path, _ = shop
    before = store.read_version(spark, path)
    new = before.loans.filter("id = 5").select(
        F.lit(1).cast("long").alias("arrival"), F.lit(None).cast("long").alias("id"),
        F.lit(date(2024, 1, 1)).alias("start_date"), F.lit(date(2024, 1, 9)).alias("end_date"),
        F.lit(None).cast("date").alias("return_date"), "book_id", "client_id",
    )
    outcome = ingest.append_loans(before, new)
    store.append(path, "loan", outcome.accepted)
    assert rows(store.read_version(spark, path))[2] == rows(outcome.library)[2]
    assert sorted(LOAN.names) == sorted(outcome.accepted.drop("arrival").columns)
