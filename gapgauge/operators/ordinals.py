"""Position of every row within its entity, whatever the entity's share of all rows.

Entities of ordinary size are numbered by one window each. One entity may
however hold a large share of all rows. Such entities are found by a count,
and their rows are numbered in pieces: rows on earlier days, plus rows in
earlier games of the day, plus the place inside the game. Only groups bounded
by the calendar, by the games of a day or by the length of a game are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapgauge.session import cut_lineage

DAY = ["pid", "day_key"]
GAME = ["pid", "day_key", "game_key"]

# Order inside a game. Beyond the number of the appearance the reference order
# is unspecified; the rest only makes runs repeatable.
WITHIN_GAME = ["at_bat_number", "opponent", "woba_pa", "xwoba_pa", "launch_speed"]
EVENT_ORDER = ["game_date", "game_pk", *WITHIN_GAME]

# Rows of one entity that a single task may sort.
SORT_ROWS = 500_000


# Ids up to this number (a few MB) are sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 100_000


def split_by_size(pa: DataFrame, sort_rows: int = SORT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary and of large entities; None if no entity is large.

    One scan counts the rows of each entity, and what it finds large is written.
    """
    sizes = pa.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    large = cut_lineage(sizes.filter(F.col("n") > sort_rows).select("pid"))
    n_large = large.count()
    if not n_large:
        return pa, None
    if n_large <= BROADCAST_IDS:
        large = F.broadcast(large)
    return pa.join(large, "pid", "left_anti"), pa.join(large, "pid", "left_semi")


def _with_keys(pa: DataFrame) -> DataFrame:
    """Day and game as join keys; rows without them come first, as NULLs do."""
    return pa.withColumns(
        {
            "day_key": F.coalesce(F.datediff("game_date", F.lit("1970-01-01").cast("date")), F.lit(-(1 << 31))),
            "game_key": F.coalesce("game_pk", F.lit(-(1 << 63))),
        }
    )


def game_offsets(keyed: DataFrame) -> DataFrame:
    """Per entity and game: rows before it (``before``) and rows in all (``n_rows``)."""
    earlier = (Window.unboundedPreceding, -1)
    games = keyed.groupBy(*GAME).agg(F.count(F.lit(1)).alias("n_game"))
    days = games.groupBy(*DAY).agg(F.sum("n_game").alias("n_day"))
    day_offsets = days.select(
        *DAY,
        F.sum("n_day").over(Window.partitionBy("pid").orderBy("day_key").rowsBetween(*earlier)).alias("before_day"),
        F.sum("n_day").over(Window.partitionBy("pid")).alias("n_rows"),
    )
    before_game = F.sum("n_game").over(Window.partitionBy(*DAY).orderBy("game_key").rowsBetween(*earlier))
    return (
        games.withColumn("before_game", before_game)
        .join(day_offsets, DAY)
        .select(
            *GAME,
            (F.coalesce("before_day", F.lit(0)) + F.coalesce("before_game", F.lit(0))).alias("before"),
            "n_rows",
        )
    )


def ordinals_by_entity(pa: DataFrame) -> DataFrame:
    """One window per entity: a single shuffle."""
    entity = Window.partitionBy("pid")
    place = F.row_number().over(entity.orderBy(*EVENT_ORDER)).cast("bigint") - 1
    return pa.withColumns({"ordinal": place, "n_rows": F.count(F.lit(1)).over(entity)})


def ordinals_by_game(pa: DataFrame) -> DataFrame:
    """The same numbers from counts per game; no group spans an entity."""
    keyed = _with_keys(pa)
    within = Window.partitionBy(*GAME).orderBy(*WITHIN_GAME)
    numbered = keyed.join(game_offsets(keyed), GAME).withColumn(
        "ordinal", F.col("before") + F.row_number().over(within) - 1
    )
    return numbered.select(*pa.columns, "ordinal", "n_rows")


def entity_ordinals(pa: DataFrame, sort_rows: int = SORT_ROWS) -> DataFrame:
    """Add ``ordinal`` (0-based, in event order) and ``n_rows`` per entity."""
    ordinary, large = split_by_size(pa, sort_rows)
    numbered = ordinals_by_entity(ordinary)
    return numbered if large is None else numbered.unionByName(ordinals_by_game(large))
