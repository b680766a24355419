"""Data steps that bring older snapshots up to the current schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Address given to borrowers registered before addresses were kept.
UNKNOWN_ADDRESS = "Unknown"


def backfill_due_dates(loans: DataFrame) -> DataFrame:
    """Loans without due dates: due on the return day, or on the start day."""
    due = F.coalesce(F.col("return_date"), F.col("start_date"))
    return loans.withColumn("end_date", due)


def backfill_address(clients: DataFrame) -> DataFrame:
    return clients.withColumn("address", F.lit(UNKNOWN_ADDRESS))
