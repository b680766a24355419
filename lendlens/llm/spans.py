"""Spans to remove, sent back to the documents they lie in."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.common import text_of

SPANS = "key long, id long, start int, stop int"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null), and the numbers by which a row is found again.

    Rows that repeat doc_id and text share them; rows that repeat a doc_id with another text do not. ``id`` also
    orders the documents: a null doc_id comes last.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    last = F.lit(2**63 - 1)
    return rows.select("doc_id", "text", F.xxhash64(F.isnull("doc_id"), "text").alias("key"), F.coalesce("doc_id", last).alias("id"))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds ``spans`` to keyed rows: each span as one number, start in the upper half."""
    packed = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("stop").cast("long"))
    found = spans.groupBy("key", "id").agg(F.collect_list(packed).alias("spans"))
    return rows.join(found, ["key", "id"], "left").select("doc_id", "text", "spans")


def covered(packed: list[int], length: int) -> np.ndarray:
    """Which places the spans cover."""
    x = np.array(packed, np.int64)
    edges = np.zeros(length + 1, np.int64)
    np.add.at(edges, x >> 32, 1)
    np.subtract.at(edges, x & 0xFFFFFFFF, 1)
    return np.cumsum(edges[:-1]) > 0


def span_table(key: np.ndarray, id: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Table:
    return pa.table(
        {
            "key": pa.array(key.astype(np.int64)),
            "id": pa.array(id.astype(np.int64)),
            "start": pa.array(start.astype(np.int32)),
            "stop": pa.array(stop.astype(np.int32)),
        }
    )


def joined(first: np.ndarray, stop: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in order of their start, laid over documents end to end: (document, start in it, stop in it), overlaps joined."""
    if not len(first):
        return first, first, first
    document = np.searchsorted(ends, first, "right")
    reach = np.maximum.accumulate(stop)
    new = np.concatenate([[True], (first[1:] > reach[:-1]) | (document[1:] != document[:-1])])
    at = np.flatnonzero(new)
    begin = np.concatenate([[0], ends])[document[at]]
    return document[at], first[at] - begin, np.maximum.reduceat(stop, at) - begin


def pack_parts(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def unpack_parts(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    cuts = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(data, np.int64, n, 8))])
    return [data[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
