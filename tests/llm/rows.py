"""Small tables with what the operators must take: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import random
import re

BLANK = re.compile("[ \t\n\x0b\x0c\r]+")
CLASHING = "row string, words int, size int, key string, id int, spans int, digest string, score double, kept boolean"


def words(text: str | None) -> list[str]:
    return [w for w in BLANK.split(text or "") if w]


def prose(seed: int, n: int, vocabulary: int = 200) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


def corpus() -> list[tuple]:
    """(doc_id, text, lang, source)."""
    passage = prose(99, 70)
    base = prose(1, 120)
    rows = [
        (0, base, "en", "a"),
        (1, base, "en", "a"),
        (2, base.replace(" ", "  ", 5) + "\n", "en", None),
        (3, base.replace("w1 ", "other ", 1), "en", "b"),
        (4, None, "en", "b"),
        (5, "", None, "b"),
        (6, " \t\n", "en", "c"),
        (7, "one two", "en", "c"),
        (8, "ONE  Two", "en", "c"),
        (9, passage + " " + prose(2, 60), "en", "c"),
        (10, prose(3, 50) + " " + passage, "en", "a"),
        (11, prose(4, 30) + "\n" + passage + "\n" + prose(5, 30), "en", "a"),
        (12, "same " * 300, "en", "a"),
        (13, "ñandú çé 日本 ▁ x y \x00z " + prose(6, 80), "es", "a"),
        (14, prose(7, 6000), "en", "a"),
        (None, prose(8, 60), "en", None),
        (None, prose(8, 60), "en", None),
        (16, prose(9, 90), "en", "b"),
        (16, prose(9, 90), "en", "b"),
        (-3, "line\nline\nline # $ * x\n" + prose(10, 55), "en", "d"),
    ]
    rows += [(100 + i, prose(20, 150), "en", "a") for i in range(30)]
    near = prose(21, 200).split()
    for i in range(40):
        changed = list(near)
        changed[(i * 37) % 200] = f"x{i}"
        rows.append((200 + i, " ".join(changed), "en", "a"))
    return rows


def table(spark, rows=None, extra: bool = False):
    df = spark.createDataFrame(corpus() if rows is None else rows, "doc_id long, text string, lang string, source string")
    df = df.selectExpr("*", "cast(length(text) as long) AS n_chars")
    if extra:
        named = (c.split() for c in CLASHING.split(", "))
        df = df.selectExpr("*", *[f"cast(1 AS {t}) AS `{c}`" for c, t in named])
    return df.repartition(3)


def labels(spark, rows=((0, 1, 0), (3, 1, 0), (9, 1, 0), (14, 0, 0), (12, 0, 0), (12, None, None), (None, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
