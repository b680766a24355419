"""Queries that SQL can express, against DuckDB."""

import os

import pytest
from compare import connect

from lendlens.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", queries.ORACLE)
def test_same_rows(spark, name):
    result = connect(SF_DIR).execute(queries.ORACLE[name])
    names = [d[0] for d in result.description]
    wanted = sorted(map(repr, result.fetchall()))
    found = queries.QUERIES[name](spark, SF_DIR)
    assert set(names) <= set(found.columns)
    assert sorted(repr(tuple(r)) for r in found.select(*names).collect()) == wanted


def test_each_operator_has_one_query():
    numbers = [int(name[2:].split("_")[0]) for name in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
