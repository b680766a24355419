"""Cleaning of raw text rows before they are added to a library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendlens.functions.dates import parse_iso
from lendlens.sources.library import NULLABLE

# Unicode white space and the four ASCII separators Unicode does not count.
_SPACE = r"[\s\x1c-\x1f]+"
_OUTER_SPACE = rf"(?U)\A{_SPACE}|{_SPACE}\z"


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(text, _OUTER_SPACE, "")


def parse_int(text: Column, dtype: T.DataType) -> Column:
    """Whole number with optional sign and digit grouping by ``_``, else null."""
    stripped = strip(text)
    digits = F.regexp_replace(stripped, "_", "")
    return F.when(stripped.rlike(r"\A[+-]?\d+(_\d+)*\z"), digits.try_cast(dtype))


def clean_rows(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Type the text columns of ``raw`` by ``schema`` and add ``reject_reason``.

    Text is stripped and must not be empty, numbers and ISO dates must parse.
    The reason names the first column that failed and is null for a good row.
    An ID may be left out, to be assigned. Other columns are carried along.
    """
    checks, columns = [], []
    for field in schema:
        text = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            value = strip(text)
            bad, word = value.isNull() | (value == ""), "empty"
        else:
            is_date = isinstance(field.dataType, T.DateType)
            value = parse_iso(text) if is_date else parse_int(text, field.dataType)
            optional = field.name == "id" or field.name in NULLABLE
            bad, word = value.isNull() & (text.isNotNull() if optional else F.lit(True)), "bad"
        columns.append(value.alias(field.name))
        checks.append((bad, f"{word} {field.name}"))
    carried = [c for c in raw.columns if c not in schema.names]
    return raw.select(*carried, *columns, first_reason(checks).alias("reject_reason"))


def first_reason(checks: list[tuple[Column, str]]) -> Column:
    """Name of the first check that holds, null when none does."""

    def step(rest: Column, check: tuple[Column, str]) -> Column:
        holds, name = check
        return F.when(holds, F.lit(name)).otherwise(rest)

    return reduce(step, reversed(checks), F.lit(None).cast("string"))
