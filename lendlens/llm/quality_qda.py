"""A quality classifier: regularised quadratic discriminant analysis of document statistics.

Each text gives ``len(NAMES)`` statistics (lengths, shares of kinds of characters, repetition), transformed so that
each is roughly bell-shaped. The two classes have a mean and a covariance each. A class covariance is shrunk towards
that of both classes together, and then towards a multiple of the identity. With the Cholesky factor L of a class,
worked out once, the log density of x is -(|z|^2) / 2 - sum(log diag L) with L z = x - mean. The score is the logistic
function of the difference of the log densities and log priors.

The sums behind the means and covariances are one aggregate over all labelled rows, about 100 numbers a class; nothing
else reaches the driver. Statistics are worked out once for each text, by rows, and kept in a narrow table.

Defined cases: a null text is the empty text, which is scored like any other; a doc_id with several label rows takes the
highest quality; labels without a quality are no labels; without labels of both classes all documents score 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import held_out, pieces, staged, texts

NAMES = (
    "words", "word_length", "capitals", "marks", "symbols", "digits", "distinct", "echoes", "lines", "repeated_lines", "stops",
)
BATCH_BYTES = 16 << 20
#: Cases of the usual kind that each share starts with.
PRIOR = 20
SHRINK_TO_POOLED = 0.5
SHRINK_TO_IDENTITY = 0.05

_NOT_CAPITALS = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_MARKS = bytes(c for c in range(256) if c not in b"!?;:\"'()-")
_NOT_SYMBOLS = bytes(c for c in range(256) if c not in b"#*$%&|<>@^~_=+/\\{}[]")
_NOT_DIGITS = bytes(c for c in range(256) if c not in b"0123456789")
_NOT_STOPS = bytes(c for c in range(256) if c not in b".,")


def _share(part: float, whole: float, usual: float) -> float:
    """Log odds of a share, after ``PRIOR`` more cases with the usual share: a short text says little against it."""
    p = min((part + PRIOR * usual) / (whole + PRIOR), 0.999)
    return math.log(p / (1.0 - p))


def statistics(text: bytes) -> tuple[float, ...]:
    words = text.split()
    n = len(words)
    letters = sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        math.log(n + 2 * PRIOR),
        math.log((letters + 5.5 * PRIOR) / (n + PRIOR)),
        _share(len(text.translate(None, _NOT_CAPITALS)) / 5.5, letters / 5.5, 0.02),
        _share(len(text.translate(None, _NOT_MARKS)), 2 * n, 0.002),
        _share(len(text.translate(None, _NOT_SYMBOLS)), 4 * n, 0.002),
        _share(len(text.translate(None, _NOT_DIGITS)) / 5.5, letters / 5.5, 0.002),
        _share(n - len(set(words)), n, 0.2),
        _share(sum(map(eq, words, words[1:])), n, 0.01),
        math.log((n + PRIOR) / (len(lines) + 1)),
        _share(len(lines) - len(set(lines)), len(lines), 0.02),
        _share(len(text.translate(None, _NOT_STOPS)), 2 * n, 0.08),
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", BATCH_BYTES):
        rows = np.array([statistics(x) for x in texts(batch.column("text"))], np.float64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(rows[:, i]) for i in range(len(NAMES)))], ["doc_id", *NAMES]
        )


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text."""
    schema = "doc_id long, " + ", ".join(f"{x} double" for x in NAMES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_features, schema)


class Model:
    """Means, Cholesky factors and log priors of classes 0 and 1."""

    def __init__(self, counts, means, factors):
        self.counts, self.means, self.factors = counts, means, factors

    @property
    def empty(self) -> bool:
        return self.means is None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.empty:
            return np.full(len(x), 0.5)
        logs = []
        for count, mean, factor in zip(self.counts, self.means, self.factors, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(-0.5 * (z * z).sum(axis=0) - np.log(np.diag(factor)).sum() + math.log(count))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def _from_sums(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float, identity: float) -> Model:
    if len(sums) < 2 or min(n for n, _, _ in sums.values()) < 2:
        return Model(None, None, None)
    counts = [sums[c][0] for c in (0, 1)]
    means = [sums[c][1] / sums[c][0] for c in (0, 1)]
    scatters = [sums[c][2] - sums[c][0] * np.outer(m, m) for c, m in zip((0, 1), means, strict=True)]
    both = sum(scatters) / sum(counts)
    factors = []
    for n, scatter in zip(counts, scatters, strict=True):
        own = (1 - pooled) * scatter / n + pooled * both
        own = (1 - identity) * own + identity * max(np.trace(own) / len(own), 1e-6) * np.eye(len(own))
        factors.append(np.linalg.cholesky(own))
    return Model(counts, means, factors)


def train(rows: DataFrame, pooled: float = SHRINK_TO_POOLED, identity: float = SHRINK_TO_IDENTITY) -> Model:
    """``rows``: quality and the statistics. Two rows of sums reach the driver."""
    pairs = [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]
    sums = rows.groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(x).alias(f"s{i}") for i, x in enumerate(NAMES)],
        *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}_{j}") for i, j in pairs],
    )
    found = {}
    for row in sums.where("quality in (0, 1)").collect():
        products = np.zeros((len(NAMES), len(NAMES)))
        for i, j in pairs:
            products[i, j] = products[j, i] = row[f"p{i}_{j}"]
        found[row["quality"]] = (float(row["n"]), np.array([row[f"s{i}"] for i in range(len(NAMES))]), products)
    return _from_sums(found, pooled, identity)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ``score``: the statistics' columns give way to it."""
    kept = [c for c in rows.columns if c not in NAMES]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in NAMES])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(model.score(x))], [*kept, "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in kept) + ", score double"
    return rows.mapInArrow(scored, schema)


def quality_labels(labels: DataFrame) -> DataFrame:
    """doc_id, quality: one row for each labelled document."""
    given = labels.where("quality is not null and doc_id is not null")
    return given.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))


def fit(rows: DataFrame, labels: DataFrame, learn: Column | None = None) -> Model:
    """Learn from the labelled rows; ``learn`` leaves out others by their doc_id."""
    used = quality_labels(labels)
    return train(rows.join(used.where(learn) if learn is not None else used, "doc_id"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; learns only from the labels that are not held out."""
    rows = staged(features(docs))
    model = fit(rows, labels, ~held_out(F.col("doc_id"), 3, 1))
    scored = score(rows, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of 0.5 or more, with the columns of ``docs``; learns from all labels.

    The statistics of each text are worked out again where the rows are, so that the texts need no shuffle.
    """
    model = fit(features(docs), labels)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            scores = model.score(np.array([statistics(x) for x in texts(batch.column("text"))], np.float64))
            yield batch.filter(pa.array(scores >= 0.5)).select(["row"])

    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(passed, rows.select("row").schema).select("row.*")
