"""Daily ingest of landed event files and snapshot ingest of the boards."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapgauge.sources.boards import load_contact_board, load_expected_board, replace_snapshot
from gapgauge.sources.calendar import pending_days, season_calendar
from gapgauge.sources.damaged import SortedRows, read_csv_days, read_json_days, read_rejected, replace_rejected
from gapgauge.sources.events import DAY_COLUMN, INGEST_DAY, append_days, logical_types, normalize_event_date, read_events, stringify_exotic
from gapgauge.sources.landing import day_folder, days_by_schema, read_folders
from gapgauge.sources.ledger import ingested_days, ledger_entries, read_ledger, record_days
from gapgauge.sources.paths import exists

log = logging.getLogger(__name__)


# Ledger scope of the number of lines set aside.
REJECTED_SCOPE = "pitches_rejected"


@dataclass(frozen=True)
class IngestPaths:
    landing: str
    events: str
    ledger: str
    rejected: str = ""

    @property
    def set_aside(self) -> str:
        """Table of malformed lines, beside the events unless given."""
        return self.rejected or self.events.rstrip("/") + "_rejected"


def _dated(rows: DataFrame) -> DataFrame:
    """Rows with the folder's day as day of ingest, and as date where they have none."""
    if DAY_COLUMN not in (c.lower() for c in rows.columns):
        rows = rows.withColumn(DAY_COLUMN, F.lit(None).cast("date"))
    dated, day = normalize_event_date(stringify_exotic(rows)), F.col("day").cast("date")
    return dated.withColumns({DAY_COLUMN: F.coalesce(DAY_COLUMN, day), INGEST_DAY: day}).drop("day")


def read_days(spark: SparkSession, landing: str, days: Iterable[date], fmt: str = "parquet", known: dict[str, str] | None = None) -> list[SortedRows]:
    """Rows of the given days, whatever columns each day has.

    Days with the same columns are read together; others apart, since putting
    them into one frame would force one type on a column. Every row of a folder
    is kept and carries the folder's day as its day of ingest; its own date may
    differ, and where it is missing it is taken from the folder.
    """
    if fmt == "csv":
        return read_csv_days(spark, landing, days, known or {})
    if fmt == "json":
        return read_json_days(spark, landing, days)
    return [SortedRows(same, read_folders(spark, landing, same, fmt, schema), None) for schema, same in days_by_schema(spark, landing, days, fmt)]


def day_counts(spark: SparkSession, events_path: str, days: list[date]) -> DataFrame:
    """Rows per day of ingest, read from the files just written."""
    return (
        read_events(spark, events_path, ingest_day=True)
        .filter(F.col(INGEST_DAY).isin(days))
        .groupBy(F.col(INGEST_DAY).alias("day"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def _ingest_together(spark: SparkSession, paths: IngestPaths, days: list[date], fmt: str) -> None:
    text = fmt in ("csv", "json")
    known = logical_types(spark, paths.events) if text else None
    for part in read_days(spark, paths.landing, days, fmt, known):
        append_days(_dated(part.good), paths.events)
        if text:
            replace_rejected(part.rejected, part.days, paths.set_aside)
    listed = spark.createDataFrame([(d,) for d in days], "day date")
    if exists(spark, paths.events):
        counts = day_counts(spark, paths.events, days)
    else:
        counts = spark.createDataFrame([], "day date, rows bigint")
    if text:
        found = read_rejected(spark, paths.set_aside).filter(F.col(INGEST_DAY).isin(days))
        aside = found.groupBy(F.col(INGEST_DAY).alias("day")).agg(F.count(F.lit(1)).alias("rows"))
        record_days(ledger_entries(aside, listed, REJECTED_SCOPE), paths.ledger)
    record_days(ledger_entries(counts, listed), paths.ledger)


def rejected_counts(spark: SparkSession, paths: IngestPaths) -> DataFrame:
    """Malformed lines by day of ingest, file, reason and field."""
    found = read_rejected(spark, paths.set_aside)
    return found.groupBy(INGEST_DAY, "file", "reason", "field").agg(F.count(F.lit(1)).alias("rows"))


def ingest_days(spark: SparkSession, paths: IngestPaths, days: list[date], fmt: str = "parquet") -> dict[date, str]:
    """Ingest days in one job; if it fails, one by one so that good days go in.

    Rows are written before the ledger, and a day is replaced as a whole, so a
    run that stops in between is simply repeated. Returns the days that failed
    and why; they are not recorded and will be asked for again. So is a day
    whose folder does not exist yet; a day without events has a folder without
    data files (a marker in it will do) and is recorded with no rows.

    Malformed lines of text files are set aside in a table of their own, by day
    and file, and their number is recorded beside that of the rows; a day of
    which most lines are malformed fails.
    """
    landed = [d for d in days if exists(spark, day_folder(paths.landing, d))]
    missing = {d: "not landed yet" for d in days if d not in landed}
    return missing | _ingest_landed(spark, paths, landed, fmt)


def _ingest_landed(spark: SparkSession, paths: IngestPaths, days: list[date], fmt: str) -> dict[date, str]:
    if not days:
        return {}
    try:
        _ingest_together(spark, paths, days, fmt)
        return {}
    except Exception as error:  # noqa: BLE001 - any source failure is isolated by day
        if len(days) == 1:
            log.warning("%s failed: %s: %s", days[0], type(error).__name__, error)
            return {days[0]: f"{type(error).__name__}: {error}"}
    failed: dict[date, str] = {}
    for day in days:
        failed |= _ingest_landed(spark, paths, [day], fmt)
    return failed


def daily_ingest(
    spark: SparkSession,
    paths: IngestPaths,
    year: int,
    through: date | None = None,
    days_back: int | None = None,
    newest_first: bool = False,
    limit_days: int | None = None,
    fmt: str = "parquet",
    days_per_job: int = 30,
    season_start: dict[int, str] | None = None,
) -> dict[date, str]:
    """Ingest every day of the season that the ledger does not hold yet."""
    calendar = season_calendar(spark, year, through, days_back, season_start)
    done = ingested_days(read_ledger(spark, paths.ledger))
    # Bounded by the length of a season.
    todo = [r["day"] for r in pending_days(calendar, done, newest_first, limit_days).collect()]
    failed: dict[date, str] = {}
    for start in range(0, len(todo), days_per_job):
        failed |= ingest_days(spark, paths, todo[start : start + days_per_job], fmt)
    return failed


def snapshot_ingest(
    read: Callable[[str], DataFrame | None],
    path: str,
    snapshot: date,
    year: int,
    board: str = "expected",
    minimum: int | None = None,
    kinds: Iterable[str] = ("batter", "pitcher"),
) -> dict[str, str]:
    """Store one board's snapshot of every kind; a kind that fails is reported.

    ``read`` returns the source frame of a kind. A kind without rows is left
    as it was stored before.
    """
    failed: dict[str, str] = {}
    for kind in kinds:
        try:
            source = read(kind)
            if source is None or source.isEmpty():
                failed[kind] = "returned nothing"
                continue
            gate = {} if minimum is None else {"minimum": minimum}
            if board == "expected":
                rows = load_expected_board(source, kind, snapshot, year, **gate)
            else:
                rows = load_contact_board(source, kind, snapshot, **gate)
            replace_snapshot(rows, path)
        except Exception as error:  # noqa: BLE001 - one board must not stop the other
            failed[kind] = f"{type(error).__name__}: {error}"
            log.warning("%s board of %s failed: %s", board, kind, failed[kind])
    return failed
