"""Batches of new, changed, returned and deleted rows.

A batch is a DataFrame with the columns of its table and ``arrival``, a unique
number that gives the order of the rows. Each function returns the next
snapshot together with the accepted rows and the rejected ones with a reason;
nothing raises for a bad row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlens.functions.dates import OPEN_END, loan_end
from lendlens.operators.audits import parent_days, required_columns
from lendlens.operators.intake import first_reason
from lendlens.operators.occupancy import furthest_return, overlap_flags, spans
from lendlens.operators.paging import numbered
from lendlens.operators.rounds import refusals, settle
from lendlens.operators.sizing import narrowed
from lendlens.session import first_partitions, staged, staged_by
from lendlens.sources.library import BOOK, CLIENT, LOAN, Library, out_now


@dataclass(frozen=True)
class Outcome:
    library: Library
    accepted: DataFrame
    rejected: DataFrame


def _null_checks(columns: list[str]) -> list[tuple[Column, str]]:
    return [(F.col(c).isNull(), f"null {c}") for c in columns]


def _judge(batch: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    """Add or complete ``reason``; a reason already given stays."""
    reason = first_reason(checks)
    if "reason" in batch.columns:
        reason = F.coalesce(F.col("reason"), reason)
    return batch.withColumn("reason", reason)


def _split(judged: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    good = judged.filter(F.col("reason").isNull()).select("arrival", *columns)
    bad = judged.filter(F.col("reason").isNotNull()).select("arrival", *columns, "reason")
    return good, bad


def _by_id(batch: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on ID. Rows without one, maybe the whole batch, are not shuffled."""
    given = batch.filter("id IS NOT NULL").join(right, "id", "left")
    return given.unionByName(batch.filter("id IS NULL"), allowMissingColumns=True)


def _known(batch: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Mark the batch rows whose ID is in the table."""
    ids = narrowed(table.select("id"), batch, "id").distinct().withColumn(name, F.lit(True))
    return _by_id(batch, ids).withColumn(name, F.coalesce(name, F.lit(False)))


def _first_of_id(judged: DataFrame) -> DataFrame:
    """Reject a row whose ID an earlier row of the batch that is still good holds."""
    shared = (
        judged.filter("reason IS NULL AND id IS NOT NULL")
        .groupBy("id")
        .agg(F.min("arrival").alias("holder"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    marked = _by_id(judged, shared.select("id", "holder"))
    return _judge(marked, [(F.col("holder") < F.col("arrival"), "id taken")]).drop("holder")


def _assign_ids(accepted: DataFrame, current: DataFrame) -> DataFrame:
    """Number the rows without an ID in arrival order, above every ID in use."""
    used = current.select("id").unionByName(accepted.select("id"))
    top = used.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    unset = numbered(accepted.filter("id IS NULL"), ["arrival"], "place")
    given = accepted.filter("id IS NOT NULL")
    named = unset.withColumn("id", F.lit(top) + F.col("place")).drop("place")
    return given.unionByName(named)


def _appended(
    judged: DataFrame, current: DataFrame, columns: list[str]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(next table, accepted rows, rejected rows) of an append."""
    accepted, rejected = _split(staged(judged), columns)
    accepted = _assign_ids(accepted, current)
    following = current.select(*columns).unionByName(accepted.select(*columns))
    return following, accepted, rejected


def _append(current: DataFrame, new: DataFrame, columns: list[str]) -> tuple:
    required = [c for c in required_columns(current.select(*columns)) if c != "id"]
    marked = _known(new, current, "known")
    judged = _judge(marked, [*_null_checks(required), (F.col("known"), "id taken")])
    return _appended(_first_of_id(judged), current, columns)


def append_books(library: Library, new: DataFrame) -> Outcome:
    table, accepted, rejected = _append(library.books, new, BOOK.names)
    return Outcome(library.with_(books=table), accepted, rejected)


def append_clients(library: Library, new: DataFrame) -> Outcome:
    table, accepted, rejected = _append(library.clients, new, CLIENT.names)
    return Outcome(library.with_(clients=table), accepted, rejected)


def _date_checks() -> list[tuple[Column, str]]:
    return [
        (F.col("end_date") < F.col("start_date"), "due before start"),
        (F.col("return_date") < F.col("start_date"), "return before start"),
    ]


def _with_parents(library: Library, batch: DataFrame) -> DataFrame:
    """Add the day the item entered stock and the day the borrower registered."""
    books = parent_days(library.books, "book_id", "added")
    clients = parent_days(library.clients, "client_id", "registered")
    return batch.join(books, "book_id", "left").join(clients, "client_id", "left")


def _parents_judged(library: Library, batch: DataFrame) -> DataFrame:
    """Check item and borrower of each loan: known, and there by its start."""
    checks = [
        (F.col("book_id_known").isNull(), "unknown book"),
        (F.col("client_id_known").isNull(), "unknown client"),
        (F.col("start_date") < F.col("added"), "before book"),
        (F.col("start_date") < F.col("registered"), "before client"),
    ]
    judged = _judge(_with_parents(library, batch), checks)
    return judged.drop("added", "registered", "book_id_known", "client_id_known")


def _spanned(batch: DataFrame) -> DataFrame:
    return batch.withColumns(
        {"first": F.col("start_date"), "last": loan_end(F.col("return_date"))}
    )


def append_loans(library: Library, new: DataFrame) -> Outcome:
    """Add loans; of new loans that collide with each other the first wins.

    An ID given twice belongs to the first row that is good by itself.
    """
    required = [c for c in required_columns(library.loans.select(*LOAN.names)) if c != "id"]
    marked = _known(new, library.loans, "known")
    checks = [*_null_checks(required), *_date_checks(), (F.col("known"), "id taken")]
    judged = _parents_judged(library, _judge(marked, checks).drop("known"))
    judged = _first_of_id(staged(_spanned(judged)))
    judged = staged(judged.withColumns({"loan": F.col("arrival"), "is_return": F.lit(False)}))
    held = narrowed(spans(library.loans), judged.filter("reason IS NULL"), "book_id")
    table, accepted, rejected = _appended(settle(judged, held), library.loans, LOAN.names)
    return Outcome(library.with_(loans=table), accepted, rejected)


def _replaced(current: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """The table with the change of each ID, one at most, in place of the row."""
    values = [c for c in columns if c != "id"]
    change = changes.select("id", F.struct(*values).alias("change"))
    rows = current.select(*columns).join(change, "id", "left")
    changed = F.col("change").isNotNull()
    return rows.select(
        "id", *[F.when(changed, F.col(f"change.{c}")).otherwise(F.col(c)).alias(c) for c in values]
    )


def _change(current: DataFrame, loans: DataFrame, changes: DataFrame, columns, key, day) -> tuple:
    """Judge changes to items or borrowers, which must not be newer than a loan."""
    starts = narrowed(loans.select(F.col(key).alias("id"), "start_date"), changes, "id")
    first = starts.groupBy("id").agg(F.min("start_date").alias("first_start"))
    marked = _known(changes, current, "known").join(first, "id", "left")
    checks = [
        *_null_checks(required_columns(current.select(*columns))),
        (~F.col("known"), "unmatched"),
        (F.col(day) > F.col("first_start"), "after a loan"),
    ]
    accepted, rejected = _split(staged(_judge(marked, checks)), columns)
    latest = accepted.groupBy("id").agg(F.max_by(F.struct(*columns[1:]), "arrival").alias("latest"))
    table = _replaced(current, latest.select("id", "latest.*"), columns)
    return table, accepted, rejected


def update_books(library: Library, changes: DataFrame) -> Outcome:
    """Replace items by ID; several changes of one item apply in arrival order."""
    table, accepted, rejected = _change(
        library.books, library.loans, changes, BOOK.names, "book_id", "added"
    )
    return Outcome(library.with_(books=table), accepted, rejected)


def update_clients(library: Library, changes: DataFrame) -> Outcome:
    table, accepted, rejected = _change(
        library.clients, library.loans, changes, CLIENT.names, "client_id", "registered"
    )
    return Outcome(library.with_(clients=table), accepted, rejected)


def _refused(checked: DataFrame) -> DataFrame:
    """New versions of loans that their own values refuse: they meet no parents or other loans, and are not written."""
    return checked.filter("reason IS NOT NULL").select("arrival", *LOAN.names, "reason")


def _parents_checked(library: Library, checked: DataFrame) -> DataFrame:
    """The other new versions, judged by their parents."""
    rest = checked.filter("reason IS NULL").select("arrival", *LOAN.names, "is_return", "reason")
    # What other columns give is added after the rows are written.
    return _spanned(staged(_parents_judged(library, rest))).withColumn("loan", F.col("id"))


def _judged_in_turn(library: Library, judged: DataFrame) -> DataFrame:
    """Judge the good ones one at a time; loans that no good one touches stay where they are."""
    good = judged.filter("reason IS NULL")
    fixed = spans(library.loans.join(good.select("id"), "id", "left_anti"))
    # Written, as they are most often few or none: Spark then knows it before it moves the loans.
    own = narrowed(library.loans, staged(good.select("id")), "id").withColumnRenamed("id", "loan")
    return settle(judged, narrowed(fixed, good, "book_id"), spans(own, "loan"))


def _replaced_by(library: Library, judged: DataFrame, refused: DataFrame) -> Outcome:
    """Put in the last accepted version of each loan."""
    accepted, rejected = _split(judged, LOAN.names)
    latest = accepted.groupBy("id").agg(F.max_by(F.struct(*LOAN.names[1:]), "arrival").alias("latest"))
    loans = _replaced(library.loans, latest.select("id", "latest.*"), LOAN.names)
    return Outcome(library.with_(loans=loans), accepted, rejected.unionByName(refused))


#: Up to so many changes are sent to the loans; with more, loans and changes are dealt by ID.
FEW_CHANGES = 100_000

_VALUES = LOAN.names[1:]


def _misfits(parents: DataFrame, named: DataFrame, key: str, day: str) -> DataFrame:
    """(id, key_misfits): by loan, the (key, start_date, unknown) of its changes whose parent is unknown or came later.

    Only the keys, days and IDs travel to the parents, and of those only the misfits come back.
    """
    asked = named.select("id", key, "start_date").dropna()
    found = asked.join(parent_days(parents, key, day), key, "left")
    unknown = F.col(f"{key}_known").isNull()
    bad = found.filter(unknown | (F.col("start_date") < F.col(day)))
    misfit = F.struct(key, "start_date", unknown.alias("unknown"))
    return bad.groupBy("id").agg(F.collect_set(misfit).alias(f"{key}_misfits"))


def _parent_checks() -> list[tuple[Column, str]]:
    """The checks of ``_parents_judged`` by what ``_misfits`` gives."""

    def among(key: str, unknown: bool) -> Column:
        same = lambda m: (m[key] == F.col(key)) & (m["start_date"] == F.col("start_date")) & (m["unknown"] == F.lit(unknown))
        return F.exists(f"{key}_misfits", same)

    return [
        (among("book_id", True), "unknown book"),
        (among("client_id", True), "unknown client"),
        (among("book_id", False), "before book"),
        (among("client_id", False), "before client"),
    ]


def _by_loan(library: Library, loans: DataFrame, named: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    """Changes and loans as one table, dealt by ID once: what later steps ask about a loan stands in its rows.

    Changes (``is_change``) come judged by their own values and their parents. The only change of a loan that is one
    row has that row's values in ``held``, and stands for it. Other loans are rows of their own, ``named`` if a change
    names them.
    """
    given = F.col("reason") if "reason" in named.columns else F.lit(None).cast("string")
    of_loans = loans.select(F.lit(False).alias("is_change"), *LOAN.names)
    of_changes = named.select(F.lit(True).alias("is_change"), "arrival", *LOAN.names, given.alias("reason"))
    both = of_changes.unionByName(of_loans, allowMissingColumns=True)
    both = both.repartition(first_partitions(named.sparkSession), "id")  # as the buckets, so they travel once
    is_change, of_id = F.col("is_change"), Window.partitionBy("id")
    rows = both.withColumns(
        {
            "versions": F.count_if(is_change).over(of_id),
            "copies": F.count_if(~is_change).over(of_id),
            "held": F.max(F.when(~is_change, F.struct(*_VALUES))).over(of_id),
        }
    )
    lone = (F.col("versions") == 1) & (F.col("copies") == 1)
    rows = rows.filter(is_change | ~lone).withColumns(
        {
            "known": F.when(F.col("copies") > 0, F.lit(True)),
            "named": F.col("versions") > 0,
            "held": F.when(is_change & lone, F.col("held")),
        }
    )
    for parents, key, day in ((library.books, "book_id", "added"), (library.clients, "client_id", "registered")):
        rows = rows.join(_misfits(parents, named, key, day), "id", "left")
    reason = F.coalesce("reason", first_reason([*checks, *_parent_checks()]))
    rows = rows.withColumn("reason", F.when(is_change, reason))
    return rows.select("is_change", "named", "arrival", *LOAN.names, "reason", "held")


def update_loans(library: Library, changes: DataFrame) -> Outcome:
    """Replace loans by ID, one at a time in arrival order.

    A change must fit the loans as the changes accepted before it left them:
    days that one gives up are free for the next, and a loan may change again.
    The changes are read several times.
    """
    checks = [
        *_null_checks(required_columns(library.loans.select(*LOAN.names))),
        (F.col("known").isNull(), "unmatched"),
        *_date_checks(),
    ]
    current = library.loans.select(*LOAN.names)
    named = changes.filter("id IS NOT NULL")
    nameless = _judge(changes.filter("id IS NULL").withColumn("known", F.lit(None).cast("boolean")), checks)
    few = named.count() <= FEW_CHANGES
    if few:
        named = staged(named)
        ids = F.broadcast(named.select("id"))
        rows = staged(_by_loan(library, current.join(ids, "id", "left_semi"), named, checks))
        untouched = current.join(ids, "id", "left_anti")
    else:
        rows = staged_by(_by_loan(library, current.filter("id IS NOT NULL"), named, checks), "id")
        rest = rows.filter("NOT is_change AND NOT named").select(*LOAN.names)
        untouched = rest.unionByName(current.filter("id IS NULL"))
    changed, several = rows.filter("is_change"), rows.filter("NOT is_change AND named").select(*LOAN.names)
    refused = _refused_in_turn(changed, several, untouched, few)
    judged = changed.join(refused, F.col("id") == F.col("loan"), "left")
    late = F.filter("refused", lambda r: r["arrival"] == F.col("arrival"))
    judged = judged.withColumn("late", F.get(late, F.lit(0)))
    judged = judged.withColumn("reason", F.coalesce("reason", "late.late_reason"))
    return _with_changes(library, judged, several, untouched, _refused(nameless))


def _refused_in_turn(changed: DataFrame, several: DataFrame, untouched: DataFrame, few: bool) -> DataFrame:
    """(loan, refused): by loan, the (arrival, late_reason, times) of good changes that do not fit."""
    good = changed.filter("reason IS NULL")
    # Written, as these too are most often none.
    moving = staged(good.filter("held IS NULL").select("id").distinct())
    left = changed.filter("reason IS NOT NULL AND held IS NOT NULL").select("id", "held.*")
    fixed = spans(untouched.unionByName(several.join(moving, "id", "left_anti")).unionByName(left))
    # A few spans beside many changes cost less to bring along than to sort out those of other items.
    if few or 4 * fixed.count() > good.count():
        fixed = narrowed(fixed, good, "book_id")
    own = spans(several.join(moving, "id", "left_semi").withColumnRenamed("id", "loan"), "loan")
    held_last = loan_end(F.col("held.return_date"))
    usable = F.col("held.book_id").isNotNull() & (F.col("held.start_date") <= held_last)
    held = {"held_book": F.col("held.book_id"), "held_first": F.col("held.start_date"), "held_last": held_last}
    batch = _spanned(good).withColumns({"loan": F.col("id"), "is_return": F.lit(False)})
    batch = batch.withColumns({name: F.when(usable, value) for name, value in held.items()})
    reasons = refusals(batch, fixed, own)
    # Of an arrival on several rows each one is refused as often as there are rows.
    times = F.count("*").over(Window.partitionBy("arrival"))
    refused = F.struct("arrival", "late_reason", "times")
    return reasons.withColumn("times", times).groupBy("loan").agg(F.collect_set(refused).alias("refused"))


def _with_changes(library: Library, judged: DataFrame, several: DataFrame, untouched: DataFrame, refused: DataFrame) -> Outcome:
    """Put in the last accepted version of each loan; ``refused`` are changes that name none."""
    good = F.col("reason").isNull()
    accepted = judged.filter(good).select("arrival", *LOAN.names)
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("late.times", F.lit(1).cast("long")))).alias("time")
    rejected = judged.filter(~good).select("arrival", *LOAN.names, "reason", times).drop("time")
    # The only change of a loan that is one row brings that row along.
    lone = judged.filter("held IS NOT NULL").select(
        "id", *[F.when(good, F.col(c)).otherwise(F.col(f"held.{c}")).alias(c) for c in _VALUES]
    )
    versions = judged.filter(good & F.col("held").isNull())
    latest = versions.groupBy("id").agg(F.max_by(F.struct(*_VALUES), "arrival").alias("latest"))
    loans = _replaced(several, latest.select("id", "latest.*"), LOAN.names)
    table = untouched.unionByName(lone).unionByName(loans)
    return Outcome(library.with_(loans=table), accepted, rejected.unionByName(refused))


def _overlapping_marked(library: Library, judged: DataFrame) -> DataFrame:
    """Mark returns whose loan, still out, overlaps another of its item.

    Such a loan ends with the calendar, so it overlaps if another is out as well or one came back after it began: two
    numbers for each item tell. Loans whose ID stands on several rows are marked by the flags of all these rows.
    """
    good = judged.filter("reason IS NULL")
    last = F.col("last")
    per_item = narrowed(spans(library.loans), good, "book_id").groupBy("book_id").agg(
        F.count_if((F.col("first") < last) & (last == F.lit(OPEN_END))).alias("out"),
        F.max(F.when(last < F.lit(OPEN_END), last)).alias("latest"),
    )
    begun = F.col("start_date")
    meets = (begun < F.lit(OPEN_END)) & ((F.col("out") > 1) | (F.col("latest") > begun))
    once = judged.join(per_item, "book_id", "left").withColumn("overlapping", F.coalesce(meets, F.lit(False)))
    once = once.drop("out", "latest")
    copies = narrowed(library.loans.select("id"), good, "id").groupBy("id").agg(F.count("*").alias("copies"))
    repeated = staged(copies.filter("copies > 1"))
    if repeated.isEmpty():
        return once
    items = narrowed(narrowed(library.loans, repeated, "id").select("book_id"), good, "book_id")
    flags = overlap_flags(narrowed(library.loans, items, "book_id")).select(F.col("loan_id").alias("id"))
    flagged = repeated.join(narrowed(flags, repeated, "id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    by_flags = flagged.select("id", F.coalesce("hit", F.lit(False)).alias("hit"))
    both = once.join(by_flags, "id", "left")
    return both.withColumn("overlapping", F.coalesce("hit", "overlapping")).drop("hit")


def record_returns(library: Library, returns: DataFrame) -> Outcome:
    """Set the return day of loans still out, from rows (arrival, id, return_date).

    Of several returns of a loan the first that is good counts; the loan is
    not out for those after it. A return only shortens a loan, so one that
    overlaps no other fits as it is; only the others are judged in turn.
    """
    asked = returns.select("arrival", "id", "return_date")
    checks = [
        *_null_checks(["id", "return_date"]),
        (F.col("known").isNull(), "unmatched"),
        (F.col("before").isNotNull(), "not out"),
        *_date_checks(),
    ]

    def checked(loans: DataFrame) -> DataFrame:
        rows = narrowed(loans, asked, "id").withColumnRenamed("return_date", "before").withColumn("known", F.lit(True))
        return _judge(_by_id(asked, rows).withColumn("is_return", F.lit(True)), checks)

    # Only loans that are out can be good: the others meet the batch for its refused rows alone.
    refused = _refused(checked(library.loans))
    judged = _parents_checked(library, checked(out_now(library.loans)).filter("known"))
    marked = staged(_overlapping_marked(library, judged))
    alone = marked.filter("NOT overlapping").drop("overlapping")
    first = alone.filter("reason IS NULL").groupBy("id").agg(F.min("arrival").alias("first_good"))
    late = [(F.col("arrival") > F.col("first_good"), "not out")]
    alone = _judge(_by_id(alone, first), late).drop("first_good")
    others = marked.filter("overlapping").drop("overlapping")
    return _replaced_by(library, _judged_in_turn(library, others).unionByName(alone), refused)


def _delete(library: Library, ids: DataFrame, table: DataFrame, key: str) -> tuple:
    marked = _known(ids.select("arrival", "id"), table, "known")
    checks = [*_null_checks(["id"]), (~F.col("known"), "unmatched")]
    accepted, rejected = _split(staged(_judge(marked, checks)), ["id"])
    gone = accepted.select("id").distinct()
    loans = library.loans.join(gone.withColumnRenamed("id", key), key, "left_anti")
    return table.join(gone, "id", "left_anti"), loans.select(*LOAN.names), accepted, rejected


def delete_books(library: Library, ids: DataFrame) -> Outcome:
    """Delete items by ID, rows (arrival, id), and their loans with them."""
    books, loans, accepted, rejected = _delete(library, ids, library.books, "book_id")
    return Outcome(library.with_(books=books, loans=loans), accepted, rejected)


def delete_clients(library: Library, ids: DataFrame) -> Outcome:
    clients, loans, accepted, rejected = _delete(library, ids, library.clients, "client_id")
    return Outcome(library.with_(clients=clients, loans=loans), accepted, rejected)


def check_loan_requests(library: Library, requests: DataFrame) -> DataFrame:
    """Decide requests (request_id, book_id, client_id, first_day, last_day).

    Adds ``accepted`` and, when refused, the first ``reason``: the item must be
    in stock by the first day and not out on any day of the closed range, the
    borrower registered by the first day.
    """
    requests = staged(requests)  # read three times
    reach = furthest_return(library.loans, requests.select("book_id", "last_day"))
    marked = _with_parents(library, requests).join(reach, ["book_id", "last_day"], "left")
    first_day = F.col("first_day")
    reason = first_reason(
        [
            (F.col("book_id_known").isNull(), "unknown book"),
            (F.col("client_id_known").isNull(), "unknown client"),
            (F.col("added") > first_day, "not in stock"),
            (F.col("reach") >= first_day, "loaned"),
            (F.col("registered") > first_day, "not registered"),
        ]
    )
    decided = marked.select(*requests.columns, reason.alias("reason"))
    return decided.withColumn("accepted", F.col("reason").isNull()).orderBy("request_id")
