"""Integrity audits: every row that breaks a rule of the library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.functions.text import iso
from lendlens.operators.occupancy import overlap_flags
from lendlens.operators.sizing import narrowed
from lendlens.session import staged
from lendlens.sources.library import NULLABLE, Library, flat_loans


def overlap_violations(library: Library, as_written: bool = False) -> DataFrame:
    """Loans (loan_id, book_id) that share days with another loan of their item.

    ``as_written`` applies the older wording, under which two returned loans of
    one item collide as soon as either starts before the other is back.
    """
    return _collisions_as_written(library.loans) if as_written else overlap_flags(library.loans)


def _two(loans: DataFrame, day: str, first: Column, names: tuple[str, str]) -> DataFrame:
    """Per item, the two foremost values of ``day``; equal days count twice."""
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(first))
    foremost = loans.select("book_id", day).withColumn("place", place).filter("place <= 2")
    return foremost.groupBy("book_id").agg(
        *[F.max(F.when(F.col("place") == i + 1, F.col(day))).alias(n) for i, n in enumerate(names)]
    )


def _collisions_as_written(loans: DataFrame) -> DataFrame:
    loans = loans.filter("book_id IS NOT NULL AND start_date IS NOT NULL")
    start, returned = F.col("start_date"), F.col("return_date")
    starts = _two(loans, "start_date", F.asc("start_date"), ("first", "second"))
    back = loans.filter(returned.isNotNull())
    returns = _two(back, "return_date", F.desc("return_date"), ("latest", "next_latest"))
    still_out = loans.filter(returned.isNull()).groupBy("book_id").agg(F.count("*").alias("open"))
    per_book = starts.join(returns, "book_id", "left").join(still_out, "book_id", "left")
    other_start = F.when(start == F.col("first"), F.col("second")).otherwise(F.col("first"))
    other_return = F.when(returned == F.col("latest"), F.col("next_latest")).otherwise(
        F.col("latest")
    )
    hit_open = (F.coalesce("open", F.lit(0)) > 1) | F.coalesce(start < F.col("latest"), F.lit(False))
    hit_back = F.coalesce(other_start < returned, F.lit(False)) | F.coalesce(
        start < other_return, F.lit(False)
    )
    hit = F.when(returned.isNull(), hit_open).otherwise(hit_back)
    return loans.join(per_book, "book_id").filter(hit).select(F.col("id").alias("loan_id"), "book_id")


def parent_days(parents: DataFrame, key: str, day: str) -> DataFrame:
    """(key, day, key_known), one row per parent and its latest day if it stands twice."""
    by_id = parents.groupBy(F.col("id").alias(key))
    return by_id.agg(F.max(day).alias(day), F.lit(True).alias(f"{key}_known"))


def _suspects(loans: DataFrame, parents: DataFrame, key: str, day: str) -> DataFrame:
    """Keys of loans whose parent is unknown or newer than its first loan.

    Columns (key, day, key_known). Loans are reduced to their first start per
    key before any shuffle, and when few keys are left, the loans themselves
    are checked in place.
    """
    first = loans.groupBy(key).agg(F.min("start_date").alias("first_start"))
    days = parent_days(parents, key, day)
    known = F.coalesce(f"{key}_known", F.lit(False))
    marked = first.filter(F.col(key).isNotNull()).join(days, key, "left")
    found = marked.filter(~known | (F.col("first_start") < F.col(day)))
    return found.select(key, day, known.alias(f"{key}_known"))


def _book_suspects(library: Library) -> DataFrame:
    return _suspects(library.loans, library.books, "book_id", "added")


def _client_suspects(library: Library) -> DataFrame:
    return _suspects(library.loans, library.clients, "client_id", "registered")


def loan_before_book(library: Library) -> DataFrame:
    dated = flat_loans(library).join(_book_suspects(library), "book_id")
    return dated.filter("start_date < added").select("loan_id", "book_id", "start_date", "added")


def loan_before_client(library: Library) -> DataFrame:
    dated = flat_loans(library).join(_client_suspects(library), "client_id")
    early = dated.filter("start_date < registered")
    return early.select("loan_id", "client_id", "start_date", "registered")


def _after_first_loan(changes: DataFrame, loans: DataFrame, key: str, day: str) -> DataFrame:
    """Changes (id, day) whose day is later than the first loan of that key."""
    starts = narrowed(loans.select(F.col(key).alias("id"), "start_date"), changes, "id")
    first = starts.groupBy("id").agg(F.min("start_date").alias("first_start"))
    return changes.join(first, "id").filter(F.col(day) > F.col("first_start"))


def book_after_loan(library: Library, changes: DataFrame) -> DataFrame:
    return _after_first_loan(changes, library.loans, "book_id", "added")


def client_after_loan(library: Library, changes: DataFrame) -> DataFrame:
    return _after_first_loan(changes, library.loans, "client_id", "registered")


def return_before_start(library: Library) -> DataFrame:
    bad = flat_loans(library).filter("return_date < start_date")
    return bad.select("loan_id", "start_date", "return_date")


def due_before_start(library: Library) -> DataFrame:
    bad = flat_loans(library).filter("end_date < start_date")
    return bad.select("loan_id", "start_date", "end_date")


def _tables(library: Library) -> dict[str, DataFrame]:
    return {"book": library.books, "client": library.clients, "loan": library.loans}


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def required_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NULLABLE and not c.endswith("_key")]


def _nulls(tables: dict[str, DataFrame]) -> DataFrame:
    def of_table(name: str, df: DataFrame) -> DataFrame:
        missing = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required_columns(df)])
        column = F.explode(F.array_compact(missing)).alias("column")
        return df.select(F.lit(name).alias("table"), "id", column)

    return _union([of_table(name, df) for name, df in tables.items()])


def null_required(library: Library) -> DataFrame:
    """(table, id, column) of every null where a value is required."""
    return _nulls(_tables(library))


def orphan_loans(library: Library) -> DataFrame:
    """(loan_id, column, key) of loans whose item or borrower does not exist."""

    def without(suspects: DataFrame, key: str) -> DataFrame:
        lost = flat_loans(library).join(suspects, key).filter(~F.col(f"{key}_known"))
        return lost.select("loan_id", F.lit(key).alias("column"), F.col(key).alias("key"))

    lost_books = without(_book_suspects(library), "book_id")
    return lost_books.unionByName(without(_client_suspects(library), "client_id"))


def _repeated(tables: dict[str, DataFrame]) -> DataFrame:
    def repeated(name: str, df: DataFrame) -> DataFrame:
        counted = df.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n"))
        return counted.filter("n > 1").select(F.lit(name).alias("table"), "id", "n")

    return _union([repeated(name, df) for name, df in tables.items()])


def duplicate_ids(library: Library) -> DataFrame:
    """(table, id, n) of IDs that stand on more than one row."""
    return _repeated(_tables(library))


def _loan_findings(library: Library) -> DataFrame:
    """The rules that look at one loan and its parents, in one pass over the loans."""

    def earlier(day: str, other: str) -> Column:
        return F.concat(iso(F.col(day)), F.lit(" < "), iso(F.col(other)))

    def orphan(key: str) -> Column:
        return F.concat(F.lit(f"{key} "), F.col(key).cast("string"))

    loans = flat_loans(library)
    rules = [
        ("loan_before_book", "start_date < added", earlier("start_date", "added")),
        ("loan_before_client", "start_date < registered", earlier("start_date", "registered")),
        ("return_before_start", "return_date < start_date", earlier("return_date", "start_date")),
        ("due_before_start", "end_date < start_date", earlier("end_date", "start_date")),
        ("orphan_loan", "NOT book_id_known", orphan("book_id")),
        ("orphan_loan", "NOT client_id_known", orphan("client_id")),
    ]
    for column in required_columns(library.loans):
        name = "loan_id" if column == "id" else column
        rules.append(("null_required", f"{name} IS NULL", F.lit(column)))
    broken = [
        F.when(F.expr(condition), F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))
        for rule, condition, detail in rules
    ]
    marked = loans.join(_book_suspects(library), "book_id", "left").join(
        _client_suspects(library), "client_id", "left"
    )
    found = marked.select("loan_id", F.inline(F.array_compact(F.array(*broken))))
    return found.select("rule", F.lit("loan").alias("table"), F.col("loan_id").alias("id"), "detail")


def _all_findings(library: Library, meeting: DataFrame, own: dict[str, DataFrame]) -> DataFrame:
    """(rule, table, id, detail) by all rules.

    The loans of ``library`` are judged with its parents, those of ``meeting`` among each other, and the rows of ``own``
    for missing values (parents) and repeated IDs.
    """

    def found(rule: str, df: DataFrame, table: Column, key: str, detail: Column) -> DataFrame:
        named = [F.lit(rule).alias("rule"), table.alias("table")]
        return df.select(*named, F.col(key).alias("id"), detail.alias("detail"))

    own_table = F.col("table")
    item = F.concat(F.lit("book "), F.col("book_id").cast("string"))
    parents = {name: own[name] for name in ("book", "client")}
    copies = F.concat(F.col("n").cast("string"), F.lit(" rows"))
    return _union(
        [
            _loan_findings(library),
            found("overlap", overlap_flags(meeting), F.lit("loan"), "loan_id", item),
            found("null_required", _nulls(parents), own_table, "id", F.col("column")),
            found("duplicate_id", _repeated(own), own_table, "id", copies),
        ]
    )


def audit_all(library: Library) -> DataFrame:
    """All violations as (rule, table, id, detail)."""
    return _all_findings(library, library.loans, _tables(library))


def _rows_of(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ID is named; a null among the names stands for the rows without an ID."""
    named = ids.select(F.col("id").alias("named_id"))
    return table.join(named, F.col("id").eqNullSafe(F.col("named_id")), "left_semi")


def _judged_anew(loans: DataFrame, named: dict[str, DataFrame]) -> DataFrame:
    """Loans that are named themselves or whose item or borrower is, by distinct names; each row once."""
    columns = loans.columns
    for key, ids in named.items():
        names = ids.select(F.col("id").alias(f"named_{key}")).withColumn(f"hit_{key}", F.lit(True))
        same = F.col("id").eqNullSafe(F.col("named_id")) if key == "id" else F.col(key) == F.col(f"named_{key}")
        loans = loans.join(names, same, "left")
    return loans.filter(F.coalesce(*[f"hit_{key}" for key in named])).select(*columns)


def audit_change(
    before: Library,
    after: Library,
    books: DataFrame | None = None,
    clients: DataFrame | None = None,
    loans: DataFrame | None = None,
) -> DataFrame:
    """The violations that a change brought: ``audit_all`` of the library after it less that before, row by row.

    ``books``, ``clients`` and ``loans`` name, in a column ``id``, the rows that differ between the two libraries: new,
    changed or gone (a null: rows without an ID); left out, that table has not changed. A row that differs and is not
    named may be missed. Looked at are the loans named, in both libraries, with their parents; the loans of parents
    named; and for overlaps the loans of items that a loan named has or had. What the change mended is not reported.
    """
    nothing = before.loans.select("id").limit(0)
    # Written, so that Spark knows how few they are before it moves the loans.
    books, clients, loans = (nothing if ids is None else staged(ids.select("id").distinct()) for ids in (books, clients, loans))
    own = {"book": books, "client": clients, "loan": loans}
    named = {"id": loans, "book_id": books, "client_id": clients}
    judged = [staged(_judged_anew(library.loans, named)) for library in (before, after)]
    moved = [_rows_of(rows, loans).select("book_id") for rows in judged]
    items = staged(moved[0].unionByName(moved[1]).distinct())

    def near(library: Library, rows: DataFrame) -> DataFrame:
        def of(parents: DataFrame, key: str) -> DataFrame:
            return narrowed(parents, rows.select(F.col(key).alias("id")), "id")

        parented = Library(of(library.books, "book_id"), of(library.clients, "client_id"), rows)
        meeting = narrowed(library.loans, items, "book_id")
        tables = _tables(library)
        return _all_findings(parented, meeting, {name: _rows_of(tables[name], ids) for name, ids in own.items()})

    return near(after, judged[1]).exceptAll(near(before, judged[0]))
