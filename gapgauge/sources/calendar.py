"""Season calendar and the days still to be ingested."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapgauge.params import SEASON_LAST_DAY, SEASON_START, SEASON_START_DEFAULT


def season_range(
    year: int, through: date | None = None, days_back: int | None = None, season_start: dict[int, str] | None = None
) -> tuple[date, date]:
    """First and last day to ask for; empty if the first is after the last.

    The source lags one day, so the last day is yesterday unless given. Past
    seasons end on a fixed day.
    """
    starts = SEASON_START if season_start is None else season_start
    start = date.fromisoformat(starts.get(year, f"{year}-{SEASON_START_DEFAULT}"))
    end = through or date.today() - timedelta(days=1)
    if end.year > year:
        end = date.fromisoformat(f"{year}-{SEASON_LAST_DAY}")
    if days_back:
        start = max(start, end - timedelta(days=days_back - 1))
    return start, end


def season_calendar(
    spark: SparkSession,
    year: int,
    through: date | None = None,
    days_back: int | None = None,
    season_start: dict[int, str] | None = None,
) -> DataFrame:
    """One row per day of the season so far."""
    start, end = season_range(year, through, days_back, season_start)
    # sequence() counts down when the bounds are reversed, hence the guard.
    if start > end:
        return spark.createDataFrame([], "day date")
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))


def pending_days(
    calendar: DataFrame, done: DataFrame, newest_first: bool = False, limit_days: int | None = None
) -> DataFrame:
    """Calendar days that the ledger does not hold, in the order of ingest."""
    order = F.col("day").desc() if newest_first else F.col("day").asc()
    todo = calendar.join(done.select("day"), "day", "left_anti").orderBy(order)
    return todo.limit(limit_days) if limit_days else todo
