from gapgauge.operators.appearances import pa_level
from gapgauge.operators.blocks import (
    block_pairs,
    eligible_entities,
    event_extent,
    half_aggregates,
    index_pairs,
    paired_halves,
)
from gapgauge.operators.checks import signal_checks
from gapgauge.operators.ordinals import entity_ordinals
from gapgauge.operators.ranks import tie_averaged_percentiles
from gapgauge.operators.resampling import bootstrap_ci, bootstrap_replicates, permutation_null, permutation_replicates, poisson_ci, poisson_replicates
from gapgauge.operators.signals import build_signals
from gapgauge.operators.splits import count_state_splits, pitch_type_mix, platoon_splits, platoon_summary
from gapgauge.operators.statistics import predictive_stats, verdict, weighted_predictive_stats
from gapgauge.operators.toplists import bottom_n, ranked_all, top_n
from gapgauge.operators.trends import rolling_means, rolling_trends, trend_points

__all__ = [
    "block_pairs",
    "count_state_splits",
    "bootstrap_ci",
    "bootstrap_replicates",
    "bottom_n",
    "build_signals",
    "eligible_entities",
    "entity_ordinals",
    "event_extent",
    "half_aggregates",
    "index_pairs",
    "pa_level",
    "paired_halves",
    "permutation_null",
    "permutation_replicates",
    "pitch_type_mix",
    "platoon_splits",
    "platoon_summary",
    "poisson_ci",
    "poisson_replicates",
    "predictive_stats",
    "ranked_all",
    "rolling_means",
    "rolling_trends",
    "signal_checks",
    "tie_averaged_percentiles",
    "top_n",
    "trend_points",
    "verdict",
    "weighted_predictive_stats",
]
