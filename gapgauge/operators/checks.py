"""Invariants of the signals as one data-quality aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapgauge.operators.signals import by_kind
from gapgauge.params import SignalParams


def _differs(a: Column, b: Column) -> Column:
    return F.abs(a - b) > F.lit(1e-8) + F.lit(1e-5) * F.abs(b)


def signal_checks(signals: DataFrame, params: SignalParams = SignalParams()) -> DataFrame:
    """One row: rows, kinds, flagged rows and the violations of each rule."""
    est, league, proj = F.col("est_woba"), F.col("league_mean_est_woba"), F.col("proj_woba_ros")
    outlook, z = F.col("outlook"), F.col("luck_z")
    expected_direction = F.when(outlook > 0, "positive regression").otherwise("negative regression")
    rules = {
        "gap_identity": _differs(F.col("luck_gap"), est - F.col("woba")),
        "outlook_sign": _differs(outlook, z * by_kind(params, "direction")),
        "direction_label": F.col("direction") != expected_direction,
        "projection_side": (proj - league) * (est - league) < -1e-15,
        "projection_pull": F.abs(proj - league) > F.abs(est - league) + 1e-12,
        "flag_threshold": F.col("flagged") & ~(F.abs(z) >= params.flag_z),
        "flag_qualified": F.col("flagged") & ~F.col("qualified"),
        "percentile_range": ~F.col("pct_est_woba").between(0, 100) | ~F.col("pct_woba").between(0, 100),
    }
    return signals.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("player_type").alias("n_kinds"),
        F.count_if("flagged").alias("n_flagged"),
        *[F.count_if(rule).alias(f"bad_{name}") for name, rule in rules.items()],
    )
