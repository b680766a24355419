"""Plans that have to hold at scale, on loans with one very busy item."""

from __future__ import annotations

import re
from contextlib import contextmanager
from datetime import date

import pytest
from pyspark.sql import functions as F

from lendlens.operators import audits, ingest, paging, queries, reports, sizing
from lendlens.operators.occupancy import overlap_flags, spans
from lendlens.operators.predicates import BookSearch, LoanSearch
from lendlens.plans import registry
from lendlens.sources import retail
from lendlens.sources.library import Library, flat_books, read_library, write_library

DAY = date(2024, 3, 1)


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for key, value in names.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory) -> Library:
    """60,000 loans, a third of them of item 0 and borrower 0."""
    n = F.col("id")
    start = F.date_add(F.lit(date(2024, 1, 1)), (n * 7919 % 300).cast("int"))
    loans = spark.range(60_000).select(
        n.alias("id"),
        start.alias("start_date"),
        F.date_add(start, 14).alias("end_date"),
        F.when(n % 11 != 0, F.date_add(start, (n % 23).cast("int"))).alias("return_date"),
        F.when(n % 3 == 0, 0).otherwise(n % 5000).alias("book_id"),
        F.when(n % 3 == 0, 0).otherwise(n % 900).alias("client_id"),
    )
    texts = [F.lit("n" * 40).alias("name"), F.lit(2000).alias("year"), F.lit("a").alias("author")]
    long_ago = F.lit(date(2020, 1, 1))
    books = spark.range(5000).select("id", *texts, F.lit("g").alias("genre"), long_ago.alias("added"))
    clients = spark.range(900).select(
        "id", F.lit("c").alias("name"), long_ago.alias("registered"), F.lit("x").alias("address")
    )
    path = str(tmp_path_factory.mktemp("skewed") / "lib")
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        write_library(Library(books, clients, loans), path)
    return read_library(spark, path)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flags_of_busy_items_equal_a_pair_join(skewed):
    # A third of all loans is of item 0, and many other items are as busy as can be paired here.
    loans = skewed.loans.withColumn("book_id", F.expr("if(book_id = 0, id % 40 * 10000, book_id)"))
    own = spans(loans, "id")
    other = own.selectExpr("id AS other", "book_id AS b", "first AS f", "last AS l")
    meets = F.expr("book_id = b AND id <> other AND first < l AND f < last")
    expected = own.join(other, meets, "left_semi").select(F.col("id").alias("loan_id"), "book_id")
    found = overlap_flags(loans)
    assert found.exceptAll(expected).count() == 0 and expected.exceptAll(found).count() == 0
    assert found.count() > 20_000 and overlap_flags(skewed.loans).count() > 20_000


def test_busy_item_is_split_in_the_joins(spark, skewed):
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="32k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="64k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__files__maxPartitionBytes="128k",
    ):
        late = queries.overdue_rows(skewed, date(2024, 12, 31))
        found = late.collect()
        assert "skew=true" in plan_of(late)
    assert len(found) == queries.overdue_rows(skewed, date(2024, 12, 31)).count()


@pytest.mark.parametrize(
    "make",
    [
        lambda lib: queries.unloaned_books_at(lib, DAY),
        lambda lib: queries.expired_loans_at(lib, DAY),
        lambda lib: queries.book_history(lib),
        reports.genre_scores,
        reports.last_visit_dates,
        reports.unreturned_loans_per_client,
        audits.overlap_violations,
        lambda lib: audits.overlap_violations(lib, as_written=True),
        audits.audit_all,
    ],
)
def test_no_step_gathers_the_loans(skewed, make):
    plan = plan_of(make(skewed))
    assert "SinglePartition" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_loans_are_counted_before_they_are_shuffled(spark, skewed):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        for report in (reports.genre_scores, reports.total_loans_per_client):
            plan = plan_of(report(skewed))
            assert re.search(r"partial_count.*\n.*(Filter|Project|Scan)", plan)


def test_scans_are_narrow_and_filtered(spark, skewed):
    with settings(spark, spark__sql__maxMetadataStringLength="1000"):
        plan = plan_of(queries.unloaned_books_at(skewed, DAY, BookSearch(name="NN")))
        still_out = plan_of(queries.unreturned_loans(skewed))
    assert "StringContains(name_key,nn)" in plan
    assert "LessThanOrEqual(start_date,2024-03-01)" in plan
    assert "Or(IsNull(return_date),GreaterThan(return_date,2024-03-01))" in plan
    assert "ReadSchema: struct<start_date:date,return_date:date,book_id:bigint>" in plan
    assert "IsNull(return_date)" in still_out


def test_open_loans_lie_apart(skewed):
    files = skewed.loans.groupBy(F.input_file_name().alias("file")).agg(
        F.count_if(F.col("return_date").isNull()).alias("open")
    )
    assert files.filter("open > 0").count() <= 2 < files.count()


def test_numbering_gathers_nothing(skewed):
    rows = paging.numbered(skewed.loans.select("id", "book_id"), ["book_id", "id"])
    found = rows.agg(
        F.count("*"), F.count_distinct("row_number"), F.max("row_number"), F.min("row_number")
    )
    assert tuple(found.first()) == (60_000, 60_000, 60_000, 1)
    assert "SinglePartition" not in plan_of(rows)


def nodes(plan):
    """The nodes of a plan that has run, those of its query stages too."""
    yield plan
    inner = getattr(plan, "executedPlan", None) if "Adaptive" in plan.nodeName() else None
    below = [inner()] if inner else [plan.plan()] if "QueryStage" in plan.nodeName() else []
    if not below:
        children = plan.children()
        below = [children.apply(i) for i in range(children.size())]
    for child in below:
        yield from nodes(child)


def rows_out(df) -> list[tuple[str, int]]:
    """Rows that each step of a collected frame gave."""
    found = []
    for node in nodes(df._jdf.queryExecution().executedPlan()):
        if node.metrics().contains("numOutputRows"):
            found.append((node.nodeName(), node.metrics().apply("numOutputRows").value()))
    return found


def test_a_deep_page_moves_its_own_rows(spark, skewed):
    order = ["book_id", "start_date", "id"]
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        ranked = paging.ranked(skewed.loans.select(*order), order)
    assert len(ranked.sizes) > 1 and ranked.count == 60_000
    wanted = [tuple(r) for r in skewed.loans.select(*order).orderBy(*order).collect()]
    edge = ranked.sizes[0][1]
    for start, count in ((50_000, 25), (edge - 3, 7), (59_990, 50), (60_000, 5), (0, 3)):
        found = ranked.page(start, count)
        assert [tuple(r) for r in found.collect()] == wanted[start : start + count]
        steps = rows_out(found)
        assert "TakeOrdered" not in plan_of(found)
        # Two files at most; the sort by ranges looks at the rows once more to find its ranges.
        read = [n for name, n in steps if "Scan" in name or "Columnar" in name]
        assert all(n <= 2 * sum(sorted(size for _, size in ranked.sizes)[-2:]) for n in read)
        assert all(n <= 2 * count for name, n in steps if "Scan" not in name and "Columnar" not in name)
        files = found.select(F.input_file_name().alias("f")).distinct().count()
        assert files <= 2
    assert [tuple(r) for r in paging.page(skewed.loans.select(*order), order, 30_000, 4).collect()] == wanted[30_000:30_004]
    for part in (slice(-20, None), slice(100, 59_000, 977), slice(-5, 3), slice(5, 9), slice(None, -59_990)):
        found = paging.sliced(skewed.loans.select(*order), order, part)
        assert [tuple(r) for r in found.collect()] == wanted[part]


def test_a_search_narrows_the_loans_before_the_joins(spark, skewed):
    search = LoanSearch(book_name="N", client_name="c", genre="G", start_min=date(2024, 2, 1))
    found = queries.expired_loans_at(skewed, DAY, search)
    plan = plan_of(found)
    assert plan.count("LeftSemi") == 2
    without = queries.expired_loans_at(skewed, DAY, LoanSearch(start_min=date(2024, 2, 1)))
    assert "LeftSemi" not in plan_of(without)
    assert found.count() == without.count() > 0
    assert queries.expired_loans_at(skewed, DAY, LoanSearch(author="b")).count() == 0


def test_key_filters_pass_over_row_groups(spark, skewed, tmp_path):
    rare = skewed.loans.withColumn("book_id", F.expr("if(id = 31234, 30001, id * 14 % 60000)"))
    read = {}
    # Without dictionaries, which rule out row groups of few keys by themselves.
    with settings(
        spark,
        parquet__block__size="65536",
        parquet__enable__dictionary="false",
        parquet__page__size__row__check__min="100",
        spark__sql__files__maxPartitionBytes="64m",
    ):
        for name, filters in (("plain", None), ("filtered", 4000)):
            write_library(skewed.with_(loans=rare), str(tmp_path / name), filters)
            found = queries.book_history(read_library(spark, str(tmp_path / name)), 30001)
            assert [r["loan_id"] for r in found.collect()] == [31234]
            read[name] = max(n for step, n in rows_out(found) if "Scan" in step and n != 900)
    assert read["filtered"] < read["plain"] / 2


def new_loans(skewed, days=400):
    return skewed.loans.select(
        F.col("id").alias("arrival"),
        F.lit(None).cast("long").alias("id"),
        F.date_add("start_date", days).alias("start_date"),
        F.date_add("end_date", days).alias("end_date"),
        F.date_add("start_date", (days + F.col("id") % 4).cast("int")).alias("return_date"),
        "book_id",
        "client_id",
    )


def test_large_batches_are_not_broadcast(spark, skewed):
    asked = skewed.loans.select("book_id")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="1k", spark__sql__adaptive__enabled="false"):
        plan = plan_of(sizing.narrowed(skewed.loans, asked, "book_id"))
    assert "LeftSemi" in plan and "Broadcast" not in plan


def test_batches_give_the_same_rows_when_nothing_is_broadcast(spark, skewed):
    def rows():
        outcome = ingest.append_loans(skewed, new_loans(skewed))
        return {r["arrival"]: r["id"] for r in outcome.accepted.collect()}

    small = rows()
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        assert rows() == small and len(small) > 1000


def test_books_of_the_flat_view_keep_their_keys(skewed):
    assert {"book_name_key", "author_key", "genre_key"} <= set(flat_books(skewed).columns)


SMALL = "/root/testdata/sf0.001"


def test_lines_travel_once_for_their_groups_and_the_join(spark):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false"):
        plan = plan_of(retail.loans(spark, SMALL))
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", plan)) == 1


@pytest.mark.parametrize("name", ["record_returns_table", "update_loans_table", "total_loans_after_append", "audit_all"])
def test_loans_are_worked_out_once(spark, name):
    assert "lineitem" not in plan_of(registry.ALL[name](spark, SMALL))


def test_loans_out_that_overlap_are_the_flagged_ones(spark, skewed):
    # Items with one row out, with several, with spans of no length, and loan IDs on several rows.
    loans = skewed.loans.withColumns(
        {
            "id": F.expr("if(id % 500 = 1, id - 1, id)"),
            "book_id": F.expr("if(book_id = 0, id, id % 30000 + 100000)"),
            "return_date": F.expr("if(id % 7 = 0, start_date, return_date)"),
        }
    )
    library = Library(skewed.books, skewed.clients, loans)
    out = loans.filter("return_date IS NULL AND book_id % 3 = 0")
    judged = out.select("id", "book_id", "start_date", F.lit(None).cast("string").alias("reason"))
    marked = ingest._overlapping_marked(library, judged)
    found = {r["id"] for r in marked.filter("overlapping").collect()}
    asked = sizing.narrowed(loans, judged, "book_id")
    flagged = sizing.narrowed(overlap_flags(asked).withColumnRenamed("loan_id", "id"), judged, "id")
    assert found == {r["id"] for r in flagged.collect()}
    assert 0 < len(found) < marked.select("id").distinct().count()
