"""Every named query against DuckDB on the same tables."""

import os

import pytest

from compare import assert_same, connect
from lendlens.plans import oracle, registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert registry.ALL.keys() == oracle.ALL.keys()


@pytest.mark.parametrize("name", registry.ALL)
def test_same_rows(spark, duck, name):
    assert_same(registry.ALL[name](spark, SF_DIR), duck, oracle.ALL[name])


WRITTEN = [name for name in registry.ALL if not name.startswith(("append", "update", "delete", "record", "read"))]


@pytest.fixture(scope="module")
def over_snapshot(spark):
    snapshot = registry.written_snapshot(spark, SF_DIR)
    return registry.queries_over(lambda *_: snapshot)


@pytest.mark.parametrize("name", WRITTEN)
def test_same_rows_over_a_written_library(spark, duck, over_snapshot, name):
    assert_same(over_snapshot[name](spark, SF_DIR), duck, oracle.ALL[name])
