"""Adjacent date blocks: period-1 rates paired with period-2 rates per entity."""

from __future__ import annotations

import math
from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapgauge.params import StudyParams

# Entities of a block are numbered bucket by bucket, see index_pairs.
INDEX_BUCKETS = 1021
# Rows, repeated per window length, that one task should sum.
ROWS_PER_TASK = 2_000_000


def event_extent(events: DataFrame) -> DataFrame:
    """Single row: first and last day and the number of rows of all events."""
    return events.agg(
        F.min("game_date").alias("first_day"),
        F.max("game_date").alias("last_day"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def eligible_entities(events: DataFrame, role: str, min_pa: int) -> DataFrame:
    """Entities with enough completed appearances for two halves."""
    return (
        events.filter(F.col("woba_denom") == 1)
        .groupBy(F.col(role).alias("pid"))
        .agg(F.count(F.lit(1)).alias("n_pa"))
        .filter(F.col("n_pa") >= 2 * min_pa)
    )


def half_aggregates(pa: DataFrame, first_day: date | None, windows: Iterable[int], n_rows: int = 0) -> DataFrame:
    """Per window length, half index and entity: appearances and mean rates.

    Half ``h`` of window ``W`` covers days ``[h*W, (h+1)*W)`` counted from the
    first event day, so the date ranges become an integer key. Rows are summed
    per entity and span, the longest number of days that every window length is
    made of. Spans, bounded by the calendar, are dealt by entity before they are
    repeated for every window length; ``n_rows``, the rows of ``pa`` at most,
    gives the number of tasks for that.
    """
    lengths = [int(w) for w in windows]
    days = math.gcd(*lengths) or 1
    span = F.floor(F.datediff("game_date", F.lit(first_day).cast("date")) / days).alias("span")
    spans = pa.groupBy("pid", span).agg(
        F.count(F.lit(1)).alias("n"), F.sum("woba_pa").alias("w"), F.sum("xwoba_pa").alias("x")
    )
    floor = pa.sparkSession.sparkContext.defaultParallelism
    tasks = max(floor, math.ceil(n_rows * len(lengths) / ROWS_PER_TASK))
    dealt = spans.repartition(tasks, "pid") if n_rows else spans.repartition("pid")
    length = F.explode(F.array(*[F.lit(w) for w in lengths]))
    return (
        dealt.select("pid", "span", "n", "w", "x", length.alias("win"))
        .groupBy("win", F.floor(F.col("span") * days / F.col("win")).alias("half"), "pid")
        .agg(
            F.sum("n").alias("pa"),
            (F.sum("w") / F.sum("n")).alias("woba"),
            (F.sum("x") / F.sum("n")).alias("xwoba"),
        )
    )


def pair_halves(halves: DataFrame, first_day: date | None, last_day: date | None, min_pa: int) -> DataFrame:
    """Consecutive halves of an entity side by side, both large enough.

    An entity has one row per half, so the pairing is a look at the next row
    of a group bounded by the calendar instead of a self-join.
    """
    start = F.lit(first_day).cast("date")
    n_days = F.datediff(F.lit(last_day).cast("date"), start) + 1
    following = F.lead(F.struct("half", "pa", "woba", "xwoba")).over(Window.partitionBy("win", "pid").orderBy("half"))
    return (
        halves.filter(F.col("pa") >= min_pa)
        .withColumn("following", following)
        .filter(F.col("following.half") == F.col("half") + 1)
        .filter((F.col("half") + 2) * F.col("win") <= n_days)
        .select(
            "win",
            "half",
            F.date_add(start, (F.col("half") * F.col("win")).cast("int")).alias("block_start"),
            "pid",
            F.col("pa").alias("pa_1"),
            F.col("woba").alias("woba_1"),
            F.col("xwoba").alias("xwoba_1"),
            F.col("following.pa").alias("pa_2"),
            F.col("following.woba").alias("woba_2"),
            F.col("following.xwoba").alias("xwoba_2"),
        )
    )


def gate_blocks(pairs: DataFrame, min_pairs: int) -> DataFrame:
    """Only blocks with enough pairs. One count per block, bounded by the calendar."""
    blocks = pairs.groupBy("win", "half").agg(F.count(F.lit(1)).alias("n_block")).filter(F.col("n_block") >= min_pairs)
    return pairs.join(F.broadcast(blocks.select("win", "half")), ["win", "half"], "left_semi")


def paired_halves(
    pa: DataFrame,
    events: DataFrame,
    params: StudyParams = StudyParams(),
    extent: tuple[date | None, date | None] | None = None,
) -> DataFrame:
    """Pairs of all window lengths at once, small blocks included.

    Blocks are anchored at the first day of all ``events``, of which ``pa`` may
    be a part. ``extent`` gives the first and last day where they are known,
    for instance from the ledger, and saves a look at all event files.
    """
    first_day, last_day, n_rows = (*extent, 0) if extent else event_extent(events).first()
    return pair_halves(half_aggregates(pa, first_day, params.windows, n_rows), first_day, last_day, params.min_pa)


def block_pairs(
    pa: DataFrame, events: DataFrame, params: StudyParams = StudyParams(), materialize=lambda df: df
) -> DataFrame:
    """Pairs of the blocks that have enough of them.

    ``materialize`` is applied to the pairs before they are counted; they are
    read twice and are far smaller than the events they come from.
    """
    return gate_blocks(materialize(paired_halves(pa, events, params)), params.min_pairs)


def index_pairs(pairs: DataFrame, min_pairs: int = 1) -> DataFrame:
    """Number the pairs: ``row`` over everything, ``idx`` per window, ``blk_idx`` per block.

    Blocks with fewer than ``min_pairs`` pairs are left out, as by
    ``gate_blocks``; their sizes are known here anyway.

    The order is (window, block, id bucket, id), so a window covers the rows
    ``[win_start, win_start + n)`` and a block ``[blk_start, blk_start +
    n_block)``. Counts per bucket give the offsets; only one bucket of one
    block is sorted at a time.
    """
    block, bucket = ["win", "half"], ["win", "half", "bucket"]
    earlier = (Window.unboundedPreceding, -1)

    def before(count: str, window) -> Column:
        return F.coalesce(F.sum(count).over(window.rowsBetween(*earlier)), F.lit(0))

    pairs = pairs.withColumn("bucket", F.pmod("pid", F.lit(INDEX_BUCKETS)))
    buckets = pairs.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n_bucket"))
    # One row per block: bounded by the calendar, so a single group is fine.
    blocks = (
        buckets.groupBy(*block)
        .agg(F.sum("n_bucket").alias("n_block"))
        .filter(F.col("n_block") >= min_pairs)
        .withColumn("blk_start", before("n_block", Window.partitionBy(F.lit(0)).orderBy(*block)))
        .withColumns(
            {
                "win_start": F.min("blk_start").over(Window.partitionBy("win")),
                "n": F.sum("n_block").over(Window.partitionBy("win")),
            }
        )
    )
    offsets = buckets.select(
        *bucket, before("n_bucket", Window.partitionBy(*block).orderBy("bucket")).alias("before_bucket")
    ).join(blocks, block)
    place = F.row_number().over(Window.partitionBy(*bucket).orderBy("pid")) - 1
    return (
        pairs.join(offsets, bucket)
        .withColumn("blk_idx", F.col("before_bucket") + place)
        .withColumn("row", F.col("blk_start") + F.col("blk_idx"))
        .withColumn("idx", F.col("row") - F.col("win_start"))
        .drop("bucket", "before_bucket")
    )
