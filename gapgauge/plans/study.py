"""Does the gap predict the next period? All window lengths in one run."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapgauge.operators.appearances import pa_level
from gapgauge.operators.blocks import index_pairs, paired_halves
from gapgauge.operators.resampling import bootstrap_ci, permutation_null, poisson_ci
from gapgauge.operators.statistics import predictive_stats, verdict
from gapgauge.params import StudyParams
from gapgauge.session import cut_lineage


Extent = tuple[date | None, date | None]


def study_pairs(
    events: DataFrame,
    params: StudyParams,
    role: str = "batter",
    year: int | None = None,
    extent: Extent | None = None,
) -> DataFrame:
    """Numbered pairs, written once: every statistic below starts from them.

    Blocks are anchored at the first day of all events, even when the
    appearances are limited to one year. Entities with too few appearances for
    two halves can form no pair, so they need no filter of their own.
    """
    pairs = cut_lineage(paired_halves(pa_level(events, role, year=year), events, params, extent))
    return cut_lineage(index_pairs(pairs, params.min_pairs))


def summarize(indexed: DataFrame, params: StudyParams) -> DataFrame:
    """One row per requested window length; NULLs and a note where there are no pairs."""
    windows = indexed.sparkSession.createDataFrame([(int(w),) for w in params.windows], "win int")
    blocks = indexed.groupBy("win").agg(F.count_if(F.col("blk_idx") == 0).alias("n_blocks"))
    stats = predictive_stats(indexed, ["win"]).drop("sd_w1", "sd_x1")
    boot = (poisson_ci if params.poisson else bootstrap_ci)(indexed, params.bootstrap, params.seed)
    null = permutation_null(indexed, params.permutations, params.seed)
    # Each side has at most one row per window length.
    joined = windows.join(F.broadcast(blocks), "win", "left")
    for side in (stats, boot, null):
        joined = joined.join(F.broadcast(side), "win", "left")
    found = F.col("n_blocks").isNotNull()
    text = verdict(F.col("dr_lo"), F.col("dr_hi"), F.col("n_blocks"), params.few_blocks)
    return joined.withColumn("verdict", F.when(found, text).otherwise("not enough paired blocks")).orderBy("win")


def validation_study(
    events: DataFrame,
    params: StudyParams = StudyParams(),
    role: str = "batter",
    year: int | None = None,
    extent: Extent | None = None,
) -> DataFrame:
    """Pairs, statistics, intervals, null and verdict; one row per window length."""
    return summarize(study_pairs(events, params, role, year, extent), params)
