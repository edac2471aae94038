"""Rows of the landing folder as a stream, each key once.

Files that come twice, overlap or arrive in another order are the rule with
landed data. The keys seen are state: a row is passed on if its key was not seen
within ``delay`` of event time, and a key is forgotten once the watermark has
passed it, so the state holds the keys of that span and not of all history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gapgauge.plans.ingest import IngestPaths
from gapgauge.sources.events import DAY_COLUMN, INGEST_DAY, append_days

# What identifies an event row.
EVENT_KEY = ("game_pk", "at_bat_number", "pitch_number")
STAMP = "_event_time"


def unique_rows(rows: DataFrame, keys: Sequence[str] = EVENT_KEY, event_time: str = DAY_COLUMN, delay: str = "30 days") -> DataFrame:
    """The first row of every key within ``delay``; works on streams and tables.

    A row without event time goes by the day of its folder. Rows older than the
    watermark (newest event time less ``delay``) can no longer be judged; Spark
    leaves them out and counts them, see ``late_rows``.
    """
    stamp = F.coalesce(F.col(event_time).cast("timestamp"), F.col("day").cast("timestamp"))
    stamped = rows.withColumn(STAMP, stamp)
    if not rows.isStreaming:
        return stamped.dropDuplicates(list(keys)).drop(STAMP)
    return stamped.withWatermark(STAMP, delay).dropDuplicatesWithinWatermark(list(keys)).drop(STAMP)


def dedup_stream(
    spark: SparkSession,
    paths: IngestPaths,
    checkpoint: str,
    schema: T.StructType,
    keys: Sequence[str] = EVENT_KEY,
    event_time: str = DAY_COLUMN,
    delay: str = "30 days",
    fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Start a run over all files that landed since the last one, then stop.

    The checkpoint holds which files were read and which keys were seen, so the
    next run goes on where this one ended. A micro-batch adds to the days of its
    folders; one that is repeated after a failure replaces what it wrote before.
    The table is written by this stream alone, not by ``daily_ingest``.
    """
    reader = spark.readStream.schema(T.StructType([*schema.fields, T.StructField("day", T.DateType())])).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.option("basePath", paths.landing).load(f"{paths.landing.rstrip('/')}/day=*")

    def store(batch: DataFrame, batch_id: int) -> None:
        dated = batch if DAY_COLUMN in batch.columns else batch.withColumn(DAY_COLUMN, F.col("day"))
        placed = dated.withColumns({DAY_COLUMN: F.coalesce(F.col(DAY_COLUMN).cast("date"), "day"), INGEST_DAY: F.col("day")}).drop("day")
        append_days(placed, paths.events, batch_id)

    return (
        unique_rows(rows, keys, event_time, delay)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows of this run that came after the watermark had passed them."""
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"])
