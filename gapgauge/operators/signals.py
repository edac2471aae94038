"""Gap between expected and observed rate, calibrated within each kind."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapgauge.functions import null_if_nan, numeric_columns
from gapgauge.operators.ranks import tie_averaged_percentiles
from gapgauge.params import SignalParams
from gapgauge.session import cut_lineage
from gapgauge.sources.boards import one_per_entity

# Column names of the boards and of the percentiles.
RATE_COLUMNS = ("ba", "est_ba", "slg", "est_slg", "woba", "est_woba", "pa", "bip")
CONTACT_COLUMNS = ("avg_hit_speed", "brl_percent", "ev95percent", "avg_launch_angle", "attempts")
ENTITY = ["player_type", "player_id"]

RATE_PERCENTILES = {"pct_est_woba": "est_woba", "pct_woba": "woba"}
CONTACT_PERCENTILES = {"pct_ev": "avg_hit_speed", "pct_barrel": "brl_percent", "pct_hardhit": "ev95percent"}


def latest_snapshot(board: DataFrame) -> DataFrame:
    """Single row: the last snapshot date over all kinds together."""
    return board.agg(F.max("snapshot_date").alias("snapshot_date"))


def latest_of_each_kind(board: DataFrame, as_of=None) -> DataFrame:
    """One row per kind: its last snapshot date, not after ``as_of`` if that is given."""
    known = board if as_of is None else board.filter(F.col("snapshot_date") <= F.lit(as_of).cast("date"))
    return known.groupBy("player_type").agg(F.max("snapshot_date").alias("snapshot_date"))


def at_snapshot(board: DataFrame, snapshot=None, per_kind: bool = False) -> DataFrame:
    """All rows of one snapshot, the latest unless a date is given.

    With ``per_kind`` every kind is taken at its own last snapshot (not after the
    date), so that a kind that failed on the last day does not disappear. The
    choice is spelled out as dates, hence only their partitions are read.
    """
    if per_kind:
        # As many rows as there are kinds.
        chosen = [r for r in latest_of_each_kind(board, snapshot).collect() if r["player_type"] is not None and r["snapshot_date"] is not None]
        of_kind = [(F.col("player_type") == r["player_type"]) & (F.col("snapshot_date") == F.lit(r["snapshot_date"])) for r in chosen]
        return board.filter(reduce(or_, of_kind, F.lit(False)))
    wanted = latest_snapshot(board).scalar() if snapshot is None else F.lit(snapshot).cast("date")
    return board.filter(F.col("snapshot_date") == wanted)


def by_kind(params: SignalParams, attribute: str) -> Column:
    """Constant of the row's kind, as an expression rather than a join."""
    chosen = None
    for p in params.kinds:
        value = F.lit(getattr(p, attribute))
        test = F.col("player_type") == p.kind
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return chosen


def with_gaps(board: DataFrame, params: SignalParams = SignalParams()) -> DataFrame:
    """Coerced, complete rows of the known kinds with the three gaps."""
    known = board.filter(F.col("player_type").isin(*[p.kind for p in params.kinds]))
    complete = numeric_columns(known, RATE_COLUMNS).dropna(subset=["woba", "est_woba", "pa"])
    return complete.withColumns(
        {
            "luck_gap": F.col("est_woba") - F.col("woba"),
            "ba_gap": F.col("est_ba") - F.col("ba"),
            "slg_gap": F.col("est_slg") - F.col("slg"),
            "qualified": F.col("pa") >= by_kind(params, "min_pa"),
        }
    )


def pool_calibration(gapped: DataFrame, params: SignalParams = SignalParams()) -> DataFrame:
    """Per kind: mean and sample deviation of the gap, mean expected rate.

    Taken over the qualified rows, or over all rows of the kind when the
    qualified pool is too small. At most one row per kind.
    """
    in_pool = F.when(F.col("qualified"), F.col("luck_gap"))
    large = F.count_if("qualified") > params.small_pool

    def of_pool(aggregate, column: str) -> Column:
        return F.when(large, aggregate(F.when(F.col("qualified"), F.col(column)))).otherwise(aggregate(column))

    return gapped.groupBy("player_type").agg(
        F.count(in_pool).alias("n_qualified"),
        of_pool(F.avg, "luck_gap").alias("gap_mean"),
        of_pool(F.stddev_samp, "luck_gap").alias("gap_sd"),
        of_pool(F.avg, "est_woba").alias("league_mean_est_woba"),
    )


def calibrate(gapped: DataFrame, pools: DataFrame, params: SignalParams = SignalParams()) -> DataFrame:
    """z-score, outlook, shrinkage projection and flags of every row."""
    # The calibration has one row per kind, two in all, whatever the input.
    pools = F.broadcast(pools.drop("n_qualified"))
    z = F.when(F.col("gap_sd") > 0, (F.col("luck_gap") - F.col("gap_mean")) / F.col("gap_sd"))
    shrink = by_kind(params, "shrink_pa")
    projection = (F.col("est_woba") * F.col("pa") + F.col("league_mean_est_woba") * shrink) / (F.col("pa") + shrink)
    return (
        gapped.join(pools, "player_type")
        .withColumn("luck_z", null_if_nan(z))
        .withColumns(
            {
                "outlook": F.col("luck_z") * by_kind(params, "direction"),
                "proj_woba_ros": projection,
                "flagged": F.coalesce(F.col("qualified") & (F.abs("luck_z") >= params.flag_z), F.lit(False)),
            }
        )
        .withColumns(
            {
                "proj_vs_current": F.col("proj_woba_ros") - F.col("woba"),
                # The two texts are fixed values.
                "direction": F.when(F.col("outlook") > 0, F.lit("positive regression")).otherwise(
                    F.lit("negative regression")
                ),
            }
        )
        .drop("gap_mean", "gap_sd")
    )


def attach_contact(signals: DataFrame, contact: DataFrame) -> DataFrame:
    """Left join of the contact board; entities without a row keep NULLs.

    Of an entity's repeated rows on the board the one with most attempts counts,
    so the join never adds rows.
    """
    columns = one_per_entity(contact.select(*ENTITY, *[c for c in CONTACT_COLUMNS if c in contact.columns]), ENTITY, "attempts")
    missing = {c: F.lit(None).cast("double") for c in CONTACT_COLUMNS if c not in contact.columns}
    joined = signals.join(columns, ENTITY, "left")
    return joined.withColumns(missing) if missing else joined


def rate_metrics() -> dict[str, tuple[Column, Column]]:
    return {out: (F.col(c), F.col("qualified")) for out, c in RATE_PERCENTILES.items()}


def contact_metrics() -> dict[str, tuple[Column, Column]]:
    return {out: (null_if_nan(F.col(c).cast("double")), F.col("qualified")) for out, c in CONTACT_PERCENTILES.items()}


def build_signals(
    expected: DataFrame,
    contact: DataFrame | None = None,
    params: SignalParams = SignalParams(),
    snapshot=None,
    contact_snapshot=None,
    per_kind: bool = False,
) -> DataFrame:
    """One row per entity of the snapshot with every signal attached.

    Entities below the sample gate are kept but never flagged or ranked. The
    two boards resolve their latest snapshot independently, with ``per_kind``
    separately for every kind. Without a contact board its columns and
    percentiles are NULL.
    """
    gapped = with_gaps(at_snapshot(expected, snapshot, per_kind), params)
    metrics = rate_metrics()
    if contact is not None:
        gapped = attach_contact(gapped, at_snapshot(contact, contact_snapshot, per_kind))
        metrics |= contact_metrics()
    # Read for the pools, the value counts, the percentiles and the result.
    gapped = cut_lineage(gapped)
    pools = pool_calibration(gapped, params)
    percentiles = tie_averaged_percentiles(gapped, "player_type", ["player_id"], metrics, params.small_pool)
    signals = calibrate(gapped, pools, params).join(percentiles, ENTITY, "left")
    absent = [c for c in (*CONTACT_COLUMNS, *CONTACT_PERCENTILES) if c not in signals.columns]
    return signals.withColumns({c: F.lit(None).cast("double") for c in absent}) if absent else signals
