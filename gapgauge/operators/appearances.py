"""Completed appearances with observed and expected value per row."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapgauge.functions import numeric, season_bounds

ROLES = ("batter", "pitcher")
#: A given list of at most so many entities is looked for in the files.
LISTED = 64


def entity_ids(events: DataFrame, ids: DataFrame | Iterable[int]) -> DataFrame:
    """One-column frame ``pid`` from a frame (its first column) or a short list."""
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).cast("bigint").alias("pid")).dropna().distinct()
    return events.sparkSession.createDataFrame([(int(i),) for i in ids], "pid bigint").distinct()


def recent_days(game_date: Column, days: int, as_of: date | None = None) -> Column:
    """Last ``days`` days before ``as_of`` (today by default); no upper bound."""
    today = F.current_date() if as_of is None else F.lit(as_of)
    return game_date >= F.date_sub(today, days)


def pa_level(
    events: DataFrame,
    role: str = "batter",
    ids: DataFrame | Iterable[int] | None = None,
    days: int | None = None,
    year: int | None = None,
    as_of: date | None = None,
) -> DataFrame:
    """One row per completed appearance of the role's entities.

    The expected value of a contact is modelled only where there was contact.
    Other appearances count at their actual value, else the expected rate of
    entities with few contacts would be too high.

    Without ``ids`` every entity is kept and nothing is shuffled; the filters
    on denominator and date reach the scan. So does a short list of ids: row
    groups are skipped by the statistics and Bloom filters of the event table.
    """
    if role not in ROLES:
        raise ValueError(f"role must be one of {ROLES}, got {role!r}")
    other = ROLES[1 - ROLES.index(role)]
    kept = events.filter(F.col("woba_denom") == 1)
    if ids is not None and not isinstance(ids, DataFrame):
        ids = sorted({int(i) for i in ids})
        if 0 < len(ids) <= LISTED:
            # Spelled out, since a longer IN is pushed as its range only.
            kept = kept.filter(reduce(or_, (F.col(role) == i for i in ids)))
    if days:
        kept = kept.filter(recent_days(F.col("game_date"), days, as_of))
    if year:
        kept = kept.filter(season_bounds("game_date", year))

    types = {f.name: f.dataType for f in events.schema}
    xw_bip = numeric("estimated_woba_using_speedangle", types["estimated_woba_using_speedangle"])
    value = F.coalesce(numeric("woba_value", types["woba_value"]), F.lit(0.0))
    rows = kept.select(
        F.col(role).alias("pid"),
        "game_date",
        "game_pk",
        "at_bat_number",
        F.col(other).alias("opponent"),
        "events",
        xw_bip.alias("xw_bip"),
        value.alias("woba_value"),
        "woba_denom",
        numeric("launch_speed", types["launch_speed"]).alias("launch_speed"),
        numeric("launch_angle", types["launch_angle"]).alias("launch_angle"),
        F.coalesce(xw_bip, value).alias("xwoba_pa"),
        value.alias("woba_pa"),
        xw_bip.isNotNull().alias("is_bip"),
    )
    if ids is None:
        return rows.filter(F.col("pid").isNotNull())
    return rows.join(entity_ids(events, ids), "pid", "left_semi")
