"""Incremental ingest as a stream over the landing folder.

The stream only watches which files are new; each micro-batch replaces the
days those files belong to. Replacing whole days makes a repeated batch
harmless and lets a late file correct a day that is stored already.

A day that fails does not hold up the others: it is noted in the ledger under
a scope of its own and tried again at the start of every later run.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gapgauge.plans.ingest import IngestPaths, ingest_days
from gapgauge.sources.ledger import ledger_entries, read_ledger, record_days

FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
# Ledger scope of the days to try again: one row while due, none when done.
RETRY = "stream_retry"


def _note(spark: SparkSession, paths: IngestPaths, days: Iterable[date], failed: Iterable[date]) -> None:
    due = spark.createDataFrame([(d, 1) for d in failed], "day date, rows bigint")
    listed = spark.createDataFrame([(d,) for d in days], "day date")
    record_days(ledger_entries(due, listed, RETRY), paths.ledger)


def days_to_retry(spark: SparkSession, paths: IngestPaths) -> list[date]:
    due = read_ledger(spark, paths.ledger).filter((F.col("scope") == RETRY) & (F.col("rows") > 0))
    return sorted(r["day"] for r in due.select("day").collect())


def ingest_stream(spark: SparkSession, paths: IngestPaths, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Start a run over all files that landed since the last one, then stop."""
    retried = days_to_retry(spark, paths)
    if retried:
        _note(spark, paths, retried, ingest_days(spark, paths, retried, fmt))
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILES)
        .option("recursiveFileLookup", "true")
        .load(f"{paths.landing.rstrip('/')}/day=*")
        .select("path")  # file contents are not read here
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        day = F.to_date(F.regexp_extract("path", r"day=(\d{4}-\d{2}-\d{2})", 1))
        days = sorted(r["day"] for r in batch.select(day.alias("day")).distinct().collect())
        failed = ingest_days(batch.sparkSession, paths, days, fmt)
        if failed:
            _note(batch.sparkSession, paths, failed, failed)

    return (
        files.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
