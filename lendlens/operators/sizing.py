"""Narrowing a large table to the keys of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def narrowed(big: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of ``big`` whose key the batch names.

    A plain semi join: Spark broadcasts the keys when their bytes are few, and
    else splits a busy key, which both sides being direct shuffles allows.
    """
    return big.join(batch.select(key).filter(F.col(key).isNotNull()), key, "left_semi")
