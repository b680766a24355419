"""Date rules of a loan.

Three interval conventions live side by side on purpose, and they disagree
about the return day: the as-of listing (``out_on``), the request check (both
ends included, ``operators.occupancy.furthest_return``) and the integrity rule
(half-open, ``operators.occupancy.overlap_flags``).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Return day of a loan that is still out, wherever an interval needs an end.
OPEN_END = date(9999, 12, 31)


def parse_iso(text: Column) -> Column:
    """ISO date, null when it is none.

    ``yyyy-MM-dd`` or ``yyyyMMdd``, or a week date: ``yyyy-Www``, ``yyyy-Www-d``
    and both without dashes; a week without a day is its Monday.
    """
    dashed = F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))
    plain = F.when(text.rlike(r"\A\d{8}\z"), F.try_to_date(text, "yyyyMMdd"))
    return F.coalesce(dashed, plain, _week_date(text))


def _week_date(text: Column) -> Column:
    week_form = text.rlike(r"\A\d{4}(-W\d{2}(-[1-7])?|W\d{2}[1-7]?)\z")
    digits = F.regexp_replace(text, "[-W]", "")
    year, week = F.substring(digits, 1, 4), F.substring(digits, 5, 2).try_cast("int")
    day = F.coalesce(F.substring(digits, 7, 1).try_cast("int"), F.lit(1))
    # The fourth of January always lies in week 1.
    fourth = F.try_to_date(F.concat(year, F.lit("0104")), "yyyyMMdd")
    monday = F.date_sub(fourth, F.weekday(fourth))
    found = F.date_add(monday, (week - 1) * 7 + day - 1)
    # Week 53 stands in long years only: there the Thursday is still of the year.
    thursday = F.date_add(monday, (week - 1) * 7 + 3)
    return F.when(week_form & (week >= 1) & (F.year(thursday) == year.try_cast("int")), found)


def out_on(start: Column, returned: Column, day: Column) -> Column:
    """Out on ``day``; the return day itself counts as free."""
    return (start <= day) & (returned.isNull() | (returned > day))


def loan_end(returned: Column) -> Column:
    """Return day, or the far end of the calendar while the loan is out."""
    return F.coalesce(returned, F.lit(OPEN_END))


def is_overdue(due: Column, returned: Column, at: Column) -> Column:
    """Past due at ``at`` and not returned in time; a late return stays listed."""
    return (due < at) & (returned.isNull() | (returned > due))


def days_overdue(due: Column, returned: Column, at: Column) -> Column:
    until = F.least(F.coalesce(returned, at), at)
    return F.datediff(until, due).cast("bigint")
