"""Ingest ledger: append-only entries, the latest per scope and day counts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapgauge.schemas import INGEST_LOG
from gapgauge.sources.paths import exists


def ledger_entries(counts: DataFrame, days: DataFrame, scope: str = "pitches") -> DataFrame:
    """Entries for the given days; a day without rows is recorded with zero."""
    return days.join(counts, "day", "left").select(
        F.lit(scope).alias("scope"),
        "day",
        F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"),
        F.current_timestamp().alias("fetched_at"),
    )


def latest_entries(ledger: DataFrame) -> DataFrame:
    """Current state: the last entry of every scope and day."""
    last = F.max_by(F.struct("rows", "fetched_at"), "fetched_at")
    return ledger.groupBy("scope", "day").agg(last.alias("last")).select("scope", "day", "last.rows", "last.fetched_at")


def record_days(entries: DataFrame, path: str) -> None:
    """Append entries. At most one row per day, so one file is enough."""
    entries.select(*INGEST_LOG.names).coalesce(1).write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], INGEST_LOG)
    return latest_entries(spark.read.schema(INGEST_LOG).parquet(path))


def ingested_days(ledger: DataFrame, scope: str = "pitches") -> DataFrame:
    return ledger.filter((F.col("scope") == scope) & (F.col("rows") >= 0)).select("day")


def ledger_extent(ledger: DataFrame, scope: str = "pitches") -> tuple[date | None, date | None]:
    """First and last day with rows, from the ledger instead of the event files."""
    stored = ledger.filter((F.col("scope") == scope) & (F.col("rows") > 0))
    return tuple(stored.agg(F.min("day"), F.max("day")).first())
