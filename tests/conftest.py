from __future__ import annotations

import sys
from datetime import date
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from lendlens.session import build_session  # noqa: E402
from lendlens.sources.library import BOOK, CLIENT, LOAN, Library  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "lendlens-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text: str | None) -> date | None:
    return date.fromisoformat(text) if text else None


@pytest.fixture(scope="session")
def make_library(spark):
    """Library from plain tuples; dates are ISO text."""

    def build(books=(), clients=(), loans=()) -> Library:
        return Library(
            spark.createDataFrame([(*b[:5], day(b[5])) for b in books], BOOK),
            spark.createDataFrame([(c[0], c[1], day(c[2]), c[3]) for c in clients], CLIENT),
            spark.createDataFrame([(n[0], *map(day, n[1:4]), *n[4:]) for n in loans], LOAN),
        )

    return build


@pytest.fixture(scope="session")
def golden(make_library) -> Library:
    """A small library for the cases of FIXTURES.md, section 1."""
    return make_library(
        books=[
            (10, "The Gull's Log", 1962, "M. Osei", "Travel", "2021-03-01"),
            (11, "the gull's log", 1990, "M. Osei", "travel", "2021-03-01"),
            (12, "Лёд и соль", 1954, "Р. Дымов", "Повесть", "2021-03-01"),
            (13, "Лёд и соль", 1954, "Р. Дымов", "повесть", "2021-06-15"),
            (14, "Zweite Karte", 2003, "I. Brandt", "Atlas", "2021-03-01"),
            (15, "Ångström 100%", 2011, "E. Falk", "Essay", "2021-05-20"),
        ],
        clients=[
            (21, "Nora Lindqvist", "2021-03-05", "Hamngatan 4, Kalmar"),
            (22, "Тимур Сафин", "2021-03-10", "Озёрный пер., 9, Уфа"),
            (23, "Ada Okafor", "2021-07-01", "12 Mill Lane, Derby"),
            (24, "nils Brandt", "2021-04-01", "Seestr. 31, Kiel"),
        ],
        loans=[
            (301, "2021-04-01", "2021-04-15", "2021-04-15", 10, 21),
            (302, "2021-04-15", "2021-05-06", "2021-05-20", 10, 22),
            (303, "2021-04-03", "2021-05-03", "2021-05-20", 12, 21),
            (304, "2021-05-21", "2021-06-04", "2021-05-30", 12, 24),
            (305, "2021-06-20", "2021-07-04", None, 13, 24),
            (306, "2021-05-25", "2021-05-25", "2021-05-25", 15, 22),
            (307, "2021-05-26", "2021-06-09", None, 15, 22),
            (308, "2021-06-01", "2021-06-22", "2021-07-10", 11, 21),
        ],
    )
