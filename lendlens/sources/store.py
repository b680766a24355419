"""A library kept in versions: a change writes files in proportion to itself.

``path/data`` holds the files, ``path/versions`` one small file for each version
that names the folders its three tables consist of. A version is there once its
file has its name, which is the last step; until then readers see the version
before, and files of a write that broke off belong to none. Loans lie in folders
by whether they are out and by the month they began, so a new batch adds folders,
a change of loans writes anew only the folders its rows are in, and a report of
one day opens only those it needs.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendlens.sources.library import (
    BOOK,
    BOOK_TEXT,
    CLIENT,
    CLIENT_TEXT,
    LOAN,
    Library,
    conform,
    month_key,
    with_keys,
)

SCHEMAS = {"book": BOOK, "client": CLIENT, "loan": LOAN}
LAYOUT = ["open_key", "month_key"]


class Conflict(Exception):
    """Another write has made the version in the meantime."""


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _path(spark, f"{path}/versions")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _folders(spark: SparkSession, path: str, version: int) -> dict[str, list[str]]:
    lines = spark.read.text(f"{path}/versions/{version:09d}.json").collect()
    return json.loads("".join(row[0] for row in lines))


def _publish(spark: SparkSession, path: str, version: int, tables: dict[str, list[str]]) -> int:
    """Write the file of a version under another name, then give it its own."""
    fs, draft = _path(spark, f"{path}/versions/draft-{uuid.uuid4().hex}")
    _, final = _path(spark, f"{path}/versions/{version:09d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(tables), "utf-8"))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise Conflict(f"version {version} of {path} is there already")
    return version


def _stored(name: str, df: DataFrame) -> DataFrame:
    if name == "loan":
        started = F.col("start_date")
        layout = {"open_key": F.col("return_date").isNull(), "month_key": month_key(started)}
        order = [*LAYOUT, "start_date", "id"]
        rows = df.select(*LOAN.names).withColumns(layout)
        return rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return with_keys(df, BOOK_TEXT if name == "book" else CLIENT_TEXT)


def _write(name: str, df: DataFrame, path: str) -> list[str]:
    """Write rows to folders of their own; their names below ``path``."""
    spark = df.sparkSession
    root = f"data/{uuid.uuid4().hex}/{name}"
    rows = _stored(name, df)
    if name != "loan":
        rows.write.parquet(f"{path}/{root}")
        return [root]
    rows.write.partitionBy(*LAYOUT).parquet(f"{path}/{root}")
    fs, folder = _path(spark, f"{path}/{root}")
    found = []
    for outer in fs.listStatus(folder):
        if outer.isDirectory():
            for inner in fs.listStatus(outer.getPath()):
                found.append(f"{root}/{outer.getPath().getName()}/{inner.getPath().getName()}")
    return sorted(found)


def _read(spark: SparkSession, path: str, name: str, folders: list[str]) -> DataFrame:
    schema = _stored(name, spark.createDataFrame([], SCHEMAS[name])).schema
    if not folders:
        return spark.createDataFrame([], schema)
    by_root: dict[str, list[str]] = {}
    for folder in folders:
        by_root.setdefault("/".join(folder.split("/")[:3]), []).append(f"{path}/{folder}")
    parts = [
        spark.read.schema(schema).option("basePath", f"{path}/{root}").parquet(*some)
        for root, some in by_root.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> Library:
    """The library as of a version, by default the last."""
    if version is None:
        version = versions(spark, path)[-1]
    tables = _folders(spark, path, version)
    books, clients, loans = (
        conform(_read(spark, path, name, tables[name]), schema) for name, schema in SCHEMAS.items()
    )
    return Library(books, clients, loans)


def create(library: Library, path: str) -> int:
    """Write a library as the first version of a new store."""
    spark = library.loans.sparkSession
    if versions(spark, path):
        raise Conflict(f"{path} has versions already")
    frames = {"book": library.books, "client": library.clients, "loan": library.loans}
    return _publish(spark, path, 1, {name: _write(name, df, path) for name, df in frames.items()})


def append(path: str, name: str, rows: DataFrame) -> int:
    """Add rows to a table: new files only."""
    spark = rows.sparkSession
    last = versions(spark, path)[-1]
    tables = _folders(spark, path, last)
    tables[name] += _write(name, rows.select(*SCHEMAS[name].names), path)
    return _publish(spark, path, last + 1, tables)


def replace(path: str, name: str, rows: DataFrame, gone: DataFrame | None = None) -> int:
    """Put rows in place of those of their ID, and drop those whose ID ``gone`` names.

    Only the folders that hold such rows are written anew.
    """
    spark = rows.sparkSession
    last = versions(spark, path)[-1]
    tables = _folders(spark, path, last)
    ids = rows.select("id") if gone is None else rows.select("id").unionByName(gone.select("id"))
    touched = tables[name]
    if name == "loan":
        current = _read(spark, path, name, touched).withColumn("file", F.input_file_name())
        folder = F.regexp_extract("file", r"(data/[^/]+/loan/[^/]+/[^/]+)/[^/]+$", 1)
        hit = current.join(ids, "id", "left_semi").select(folder.alias("folder")).distinct()
        touched = sorted(r["folder"] for r in hit.collect())  # folders: months, not rows
    kept = _read(spark, path, name, touched).select(*SCHEMAS[name].names).join(ids, "id", "left_anti")
    written = _write(name, kept.unionByName(rows.select(*SCHEMAS[name].names)), path)
    tables[name] = [f for f in tables[name] if f not in set(touched)] + written
    return _publish(spark, path, last + 1, tables)
