"""Session settings the jobs are written for."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # A hot book or borrower in a fact-to-dimension join is split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Bytes of input for each shuffle partition that ``build_session`` asks for to begin with.
PARTITION_BYTES = 256 << 20


def build_session(
    app: str = "lendlens", master: str | None = None, input_bytes: int | None = None, **extra: str
) -> SparkSession:
    """``input_bytes``: size of the tables, for as many shuffle partitions; adaptive execution joins small ones."""
    if input_bytes:
        number = str(max(200, input_bytes // PARTITION_BYTES))
        extra = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": number, **extra}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor sees: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def _staging_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/staged-{spark.sparkContext.applicationId}"


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    Used where a result is read more than once and must not be worked out
    twice; it survives the loss of executors. ``clear_staged`` removes the
    tables of a session.
    """
    spark = df.sparkSession
    path = f"{_staging_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def first_partitions(spark: SparkSession) -> int:
    """Shuffle partitions that Spark begins with, before adaptive execution joins small ones."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    return max(int(spark.conf.get(name, None) or 1) for name in names)


def staged_by(df: DataFrame, key: str) -> DataFrame:
    """As ``staged``, in as many buckets of the key as Spark has shuffle partitions.

    Joins and groups by the key then take the rows as they lie, and only the other side of a join is shuffled. For
    large tables alone, as a small one would be many small files. The session's catalogue knows the table while it is
    written.
    """
    spark = df.sparkSession
    buckets = min(first_partitions(spark), 100_000)
    name = f"staged_{uuid.uuid4().hex}"
    table, path = f"spark_catalog.default.{name}", f"{_staging_folder(spark)}/{name}"
    writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key)
    writer.option("path", path).option("compression", "zstd").saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its files stay
    return found


def clear_staged(spark: SparkSession) -> None:
    """Remove what this session has staged; results that still read it must be done."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_staging_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what was staged for the results worked out within."""
    try:
        yield
    finally:
        clear_staged(spark)
