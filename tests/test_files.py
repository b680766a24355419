"""Snapshots and report files, written and read back."""

import csv
import json
from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lendlens.operators import queries
from lendlens.operators.predicates import BookSearch
from lendlens.session import shared_folder, staged, staging
from lendlens.sinks.exports import (
    export_loans_geojson,
    export_overdue_tsv,
    geocode,
    overdue_tsv_lines,
    places_from,
    stub_places,
)
from lendlens.sources.library import flat_clients, read_library, write_library


def joined(path) -> str:
    return "".join(p.read_text(encoding="utf-8") for p in sorted(Path(path).glob("part-*")))


@pytest.fixture(scope="module")
def awkward(make_library):
    return make_library(
        [
            (1, 'A "q"\tB', 2000, "x\\y", 'g"', "2024-01-01"),
            (2, "plain", 1999, "a", "g", "2024-01-01"),
        ],
        [(1, 'N "n"', "2024-01-01", "Main st"), (2, "M", "2024-01-01", "Unknown")],
        [
            (1, "2024-02-01", "2024-02-05", None, 1, 1),
            (2, "2024-02-01", "2024-02-05", None, 2, 2),
            (3, "2024-01-05", "2024-01-06", "2024-01-09", 2, 1),
            (4, "2024-02-20", "2024-02-25", None, 2, 1),
        ],
    )


def test_overdue_file(awkward, tmp_path):
    export_overdue_tsv(awkward, date(2024, 2, 10), str(tmp_path / "tsv"))
    whole = joined(tmp_path / "tsv")
    assert whole.splitlines()[1] == (
        '"A ""q""\tB"\t"x\\y"\t"g"""\t2000\t"N ""n"""\t2024-01-01\t2024-02-01\t2024-02-05\t5'
    )
    rows = list(csv.reader(whole.splitlines(), delimiter="\t"))
    assert rows[0][0] == "BookName" and len(rows[0]) == 9
    assert [r[0] for r in rows[1:]] == ['A "q"\tB', "plain", "plain"]
    assert [r[8] for r in rows[1:]] == ["5", "5", "3"]


def test_geojson_file(awkward, spark, tmp_path):
    places = spark.createDataFrame(
        [("Main st", 30.5, 59.25), ("Unknown", None, None)], "address string, lon double, lat double"
    )
    export_loans_geojson(awkward, places, str(tmp_path / "geo"))
    whole = json.loads(joined(tmp_path / "geo"))
    assert whole["type"] == "FeatureCollection"
    assert [f["geometry"] for f in whole["features"]] == [
        {"type": "Point", "coordinates": [30.5, 59.25]}
    ] * 2
    assert whole["features"][0]["properties"] == {
        "book": 'A "q"\tB (x\\y, 2000 г.) [g"]',
        "client": 'N "n" [рег: 2024-01-01, адрес: Main st]',
    }


def test_geojson_file_without_features(awkward, spark, tmp_path):
    nowhere = spark.createDataFrame([], "address string, lon double, lat double")
    export_loans_geojson(awkward, nowhere, str(tmp_path / "geo"))
    assert json.loads(joined(tmp_path / "geo"))["features"] == []


def test_stub_geocoder(awkward):
    assert [tuple(r) for r in stub_places(awkward).collect()] == [("Main st", 0.0, 0.0)]


def test_caller_geocoder(awkward):
    def geocoder(address):
        return None if address == "Unknown" else (len(address) + 0.5, 1.0)

    found = {tuple(r) for r in places_from(awkward, geocoder).collect()}
    assert found == {("Main st", 7.5, 1.0), ("Unknown", None, None)}
    assert geocode(flat_clients(awkward), places_from(awkward, geocoder)).count() == 1


def test_snapshot_round_trip(golden, spark, tmp_path):
    path = str(tmp_path / "lib")
    write_library(golden, path)
    again = read_library(spark, path)
    for table in ("books", "clients", "loans"):
        names = getattr(golden, table).columns
        rows = getattr(again, table).select(*names).collect()
        assert sorted(map(str, rows)) == sorted(map(str, getattr(golden, table).collect()))
    found = queries.books(again, BookSearch(name="соль"))
    assert [r["book_id"] for r in found.collect()] == [12, 13]
    with pytest.raises(Exception, match="already exists"):
        write_library(golden, path)


def test_old_snapshots_are_upgraded(golden, spark, tmp_path):
    path = str(tmp_path / "old")
    golden.books.write.parquet(f"{path}/book")
    golden.clients.drop("address").write.parquet(f"{path}/client")
    golden.loans.drop("end_date").write.parquet(f"{path}/loan")
    upgraded = read_library(spark, path)
    due = {r["id"]: str(r["end_date"]) for r in upgraded.loans.collect()}
    assert due[302] == due[303] == "2021-05-20"
    assert (due[305], due[307]) == ("2021-06-20", "2021-05-26")
    assert {r["address"] for r in upgraded.clients.collect()} == {"Unknown"}
    assert stub_places(upgraded).count() == 0


def test_text_dates_are_parsed(golden, spark, tmp_path):
    path = str(tmp_path / "csv")
    for name, df in [("book", golden.books), ("client", golden.clients), ("loan", golden.loans)]:
        df.write.option("header", True).csv(f"{path}/{name}")
    again = read_library(spark, path, "csv", header="true")
    assert again.loans.dtypes == golden.loans.dtypes
    assert sorted(map(str, again.loans.collect())) == sorted(map(str, golden.loans.collect()))


class Settings:
    def __init__(self, **values):
        self.conf = {k.replace("__", "."): v for k, v in values.items()}


def test_shared_folder_is_the_one_the_cluster_names():
    named = Settings(spark__checkpoint__dir="hdfs:///shared", spark__master="yarn")
    assert shared_folder(named) == "hdfs:///shared"
    unnamed = Settings(spark__master="yarn", spark__sql__warehouse__dir="hdfs:///warehouse")
    assert shared_folder(unnamed) == "hdfs:///warehouse"


def test_staged_tables_go_with_the_work(spark):
    with staging(spark):
        kept = staged(spark.range(3))
        assert kept.count() == 3
        folder = Path(kept.inputFiles()[0].removeprefix("file:").replace("//", "/")).parent
    assert not folder.exists() and not folder.parent.exists()


def test_a_bad_text_date_stops_the_job(golden, spark, tmp_path):
    path = str(tmp_path / "csv")
    golden.books.write.option("header", True).csv(f"{path}/book")
    golden.clients.write.option("header", True).csv(f"{path}/client")
    late = F.when(F.col("id") == 304, F.lit("2021-5-30")).otherwise(F.col("return_date").cast("string"))
    golden.loans.withColumn("return_date", late).write.option("header", True).csv(f"{path}/loan")
    library = read_library(spark, path, "csv", header="true")
    with pytest.raises(Exception, match="return_date is not an ISO date: 2021-5-30"):
        queries.unreturned_loans(library).collect()


def test_text_formats_take_their_schemas(golden, spark, tmp_path):
    path = str(tmp_path / "json")
    schemas = {}
    for name, df in (("book", golden.books), ("client", golden.clients), ("loan", golden.loans)):
        df.write.json(f"{path}/{name}")
        schemas[name] = ", ".join(f"{c} {'string' if t == 'date' else t}" for c, t in df.dtypes)
    again = read_library(spark, path, "json", schemas)
    assert sorted(map(str, again.loans.collect())) == sorted(map(str, golden.loans.collect()))


def test_overdue_lines_keep_their_fields(make_library):
    library = make_library(
        [(1, "n", 2000, None, "g", "2024-01-01")],
        [(1, None, None, "x")],
        [(1, None, "2024-02-05", None, 1, 1)],
    )
    lines = [r[0] for r in overdue_tsv_lines(library, date(2024, 3, 1)).collect()]
    assert lines[1:] == ['"n"\t""\t"g"\t2000\t""\t\t\t2024-02-05\t25']
