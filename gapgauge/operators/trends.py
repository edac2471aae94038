"""Trailing means over the last N appearances of every entity."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from gapgauge.operators.appearances import pa_level
from gapgauge.operators.ordinals import (
    EVENT_ORDER,
    SORT_ROWS,
    entity_ordinals,
    ordinals_by_entity,
    ordinals_by_game,
    split_by_size,
)
from gapgauge.params import TrendParams

# Rows of a large entity that a single task sorts at a time.
SEGMENT_ROWS = 262_144

ROLLED = ["x_roll", "w_roll", "ev_roll"]


def _trailing(column: str, frame: WindowSpec, minimum: int) -> Column:
    return F.when(F.count(column).over(frame) >= minimum, F.avg(column).over(frame))


def _means(rows: DataFrame, by: list[str], order: list[str], params: TrendParams) -> DataFrame:
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(params.window - 1), 0)
    return rows.withColumns(
        {
            "x_roll": _trailing("xwoba_pa", frame, params.warmup),
            "w_roll": _trailing("woba_pa", frame, params.warmup),
            "ev_roll": _trailing("launch_speed", frame, params.contact_minimum),
        }
    )


def _in_segments(numbered: DataFrame, params: TrendParams, segment_rows: int) -> DataFrame:
    """Means of entities too long for one task, segment by segment.

    The last rows of a segment are repeated at the head of the next one, so
    every frame is whole; the repeats are dropped afterwards.
    """
    lookback = params.window - 1
    home = F.floor(F.col("ordinal") / segment_rows)
    in_tail = F.col("ordinal") % segment_rows >= segment_rows - lookback
    segments = F.when(in_tail, F.array(home, home + 1)).otherwise(F.array(home))
    placed = numbered.select("*", home.alias("home"), F.explode(segments).alias("segment"))
    return _means(placed, ["pid", "segment"], ["ordinal"], params).filter(F.col("segment") == F.col("home")).drop("home", "segment")


def rolling_means(
    pa: DataFrame,
    params: TrendParams = TrendParams(),
    sort_rows: int = SORT_ROWS,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Trailing means at every appearance."""
    if segment_rows < params.window:
        raise ValueError("a segment must not be shorter than the window")
    pa = pa.select("pid", *EVENT_ORDER)
    ordinary, large = split_by_size(pa, sort_rows)
    kept = ["pid", "game_date", "ordinal", "n_rows", "xwoba_pa", "woba_pa", "launch_speed"]
    # The same order as the numbering, so that both share one sort.
    rolled = _means(ordinals_by_entity(ordinary), ["pid"], EVENT_ORDER, params).select(*kept, *ROLLED)
    if large is None:
        return rolled
    return rolled.unionByName(_in_segments(ordinals_by_game(large).select(*kept), params, segment_rows))


def trend_points(pa: DataFrame, params: TrendParams = TrendParams(), sort_rows: int = SORT_ROWS) -> DataFrame:
    """Thinned series: about ``points`` evenly spaced points per entity and the last.

    The expected value is never NULL, so the warm-up drops exactly the first
    ``warmup - 1`` rows and the place of each point follows from the ordinal.
    Rows outside the trailing frame of every kept point are discarded before
    the shuffle: an entity keeps at most about 2 x points x window rows.
    """
    first = params.warmup - 1
    n_points = F.col("n_rows") - first
    step = F.greatest(F.lit(1), F.floor(n_points / params.points))
    place = F.col("ordinal") - first

    # The next kept point at or after this row: on the step grid, or the last row.
    on_grid = F.greatest(F.ceil(place / step), F.lit(0)) * step
    next_point = F.least(on_grid, n_points - 1)
    needed = (n_points > 0) & (next_point - place < params.window)

    rows = (
        entity_ordinals(pa.select("pid", *EVENT_ORDER), sort_rows)
        .filter(needed)
        .select("pid", "game_date", "ordinal", "n_rows", "xwoba_pa", "woba_pa", "launch_speed")
    )
    # Kept frames may follow one another with a gap, but each is contiguous and
    # complete, so a frame counted in kept rows ends where it should.
    return (
        _means(rows, ["pid"], ["ordinal"], params)
        .filter((place >= 0) & ((place % step == 0) | (place == n_points - 1)))
        .select(
            "pid",
            F.col("game_date").alias("d"),
            place.alias("pa"),
            F.bround("x_roll", 4).alias("x"),
            F.bround("w_roll", 4).alias("w"),
            F.bround("ev_roll", 1).alias("ev"),
            (F.col("ordinal") + 1).alias("appearance"),
        )
    )


def rolling_trends(
    events: DataFrame,
    ids: DataFrame | Iterable[int] | None,
    role: str = "batter",
    params: TrendParams = TrendParams(),
    as_of: date | None = None,
) -> DataFrame:
    """One row per entity: its thinned points in order, about 2 x points at most."""
    points = trend_points(pa_level(events, role, ids, days=params.days, as_of=as_of), params)
    point = F.struct("pa", "d", "x", "w", "ev")
    ordered = F.array_sort(F.collect_list(point))
    return points.groupBy("pid").agg(
        F.transform(ordered, lambda p: F.struct(p["d"].alias("d"), p["pa"].alias("pa"), p["x"].alias("x"),
                                                p["w"].alias("w"), p["ev"].alias("ev"))).alias("points")
    )
