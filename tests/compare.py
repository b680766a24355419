"""Compare a Spark result with DuckDB's, as multisets of rows."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def rows(columns: list[str], values) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(row[i] for i in order) for row in values)


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    expected = rows(names, result.fetchall())
    found = rows(df.columns, (tuple(r) for r in df.collect()))
    missing, extra = expected - found, found - expected
    assert not missing and not extra, (
        f"{sum(missing.values())} missing, {sum(extra.values())} extra, "
        f"e.g. {list(missing)[:2]} / {list(extra)[:2]}"
    )
