"""Bootstrap and permutation replicates as keyed data instead of loops.

Both take pairs numbered by ``index_pairs``, best written once with
``cut_lineage``. Draws come from digests of (seed, window, replicate, row), so
a task that is run again draws the same rows. A replicate is a grouping key;
its rows are reduced to moments inside each task before anything is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapgauge.functions import unit_draw
from gapgauge.operators.statistics import predictive_stats, weighted_predictive_stats

# Pairs up to this number (three doubles and a row number each, 16 MB in all)
# are sent to every task; beyond it both sides are shuffled on the row number.
BROADCAST_PAIRS = 500_000
# Resampled rows one task should produce.
ROWS_PER_TASK = 2_000_000
# Rows of one replicate of one block that a single task sorts.
SORT_ROWS = 262_144


def _spread(indexed: DataFrame, replicates: int, by: Sequence[str] = ("win", "idx")) -> tuple[DataFrame, int]:
    """Rows x replicates, over enough tasks; also the number of pairs."""
    n_pairs = indexed.count()
    floor = indexed.sparkSession.sparkContext.defaultParallelism
    tasks = max(floor, math.ceil(n_pairs * replicates / ROWS_PER_TASK))
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    return indexed.repartition(tasks, *by).withColumn("rep", reps), n_pairs


def _lookup(side: DataFrame, n_pairs: int) -> DataFrame:
    return F.broadcast(side) if n_pairs <= BROADCAST_PAIRS else side


def bootstrap_replicates(indexed: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Statistics of every replicate: n draws with replacement of n pair rows."""
    draws, n_pairs = _spread(indexed.select("win", "idx", "win_start", "n"), replicates)
    drawn = F.floor(unit_draw(F.lit(seed), F.lit("boot"), "win", "rep", "idx") * F.col("n"))
    # Never NULL, so that the join adds no filter that would draw a second time.
    row = F.coalesce(F.col("win_start") + drawn, F.lit(0))
    sample = draws.select("win", "rep", row.alias("row")).join(
        _lookup(indexed.select("row", "woba_1", "xwoba_1", "woba_2"), n_pairs), "row"
    )
    stats = predictive_stats(sample, ["win", "rep"])
    return stats.filter((F.col("sd_w1") > 0) & (F.col("sd_x1") > 0))


#: Chances that a Poisson(1) number is at most 0, 1, 2, ...; the next one is 1 to 48 bits.
POISSON_ONE = tuple(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(17))


def poisson_replicates(pairs: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Statistics of every replicate, each pair counted a Poisson(1) number of times.

    An approximation of drawing n of n rows that needs no numbering and looks
    nothing up: a pair's counts come from digests of (seed, window, block, id,
    replicate). Pairs are repeated per replicate inside a task and added up
    there; what moves is one row of sums for each task, window and replicate.
    """
    # One row per window length. Differences of sums are taken around the means.
    names = ("woba_1", "xwoba_1", "woba_2")
    centre = F.broadcast(pairs.groupBy("win").agg(F.avg("woba_1").alias("centre")))
    centred = pairs.join(centre, "win").select("win", "half", "pid", *[(F.col(c) - F.col("centre")).alias(c) for c in names])
    rows, _ = _spread(centred, replicates, ("win", "half", "pid"))
    u = unit_draw(F.lit(seed), F.lit("poisson"), "win", "half", "pid", "rep")
    times = sum((F.when(F.col("u") >= p, 1).otherwise(0) for p in POISSON_ONE), F.lit(0))
    # No filter on the counts: it would be moved below the digest and draw once
    # for each of the chances. Rows that count zero times add nothing.
    weighted = rows.withColumn("u", u).withColumn("times", times)
    stats = weighted_predictive_stats(weighted, ["win", "rep"], "times")
    # Sums that should cancel leave a trace of rounding.
    return stats.filter((F.col("sd_w1") > 1e-12) & (F.col("sd_x1") > 1e-12))


def interval(replicates: DataFrame) -> DataFrame:
    """95% interval of the correlation difference and of the partial beta per window.

    A replicate whose difference is undefined leaves the interval undefined.
    """
    bounds = F.array(F.lit(0.025), F.lit(0.975))

    def of(column: str) -> Column:
        return F.when(F.count(column) == F.count(F.lit(1)), F.percentile(column, bounds))

    return (
        replicates.groupBy("win")
        .agg(F.count(F.lit(1)).alias("n_boot"), of("dr").alias("dr"), of("b_partial").alias("bp"))
        .select(
            "win",
            "n_boot",
            F.col("dr")[0].alias("dr_lo"),
            F.col("dr")[1].alias("dr_hi"),
            F.col("bp")[0].alias("bp_lo"),
            F.col("bp")[1].alias("bp_hi"),
        )
    )


def bootstrap_ci(indexed: DataFrame, replicates: int = 1000, seed: int = 20260829) -> DataFrame:
    """Interval from replicates that draw n of the n pairs of a window."""
    return interval(bootstrap_replicates(indexed, replicates, seed))


def poisson_ci(pairs: DataFrame, replicates: int = 1000, seed: int = 20260829) -> DataFrame:
    """Interval from replicates that count each pair a Poisson(1) number of times."""
    return interval(poisson_replicates(pairs, replicates, seed))


def shuffled_positions(indexed: DataFrame, replicates: int, seed: int, sort_rows: int = SORT_ROWS) -> DataFrame:
    """A new place ``pos`` inside its block for every row of every replicate.

    Rows are ordered by a random number. A block too large for one sort is
    split into equal ranges of that number; counts per range give the offsets,
    and the places are the same as with one sort.
    """
    largest = indexed.agg(F.max("n_block")).first()[0] or 0
    rows, _ = _spread(indexed.select("win", "half", "idx", "blk_idx", "blk_start", "n_block", "xwoba_1"), replicates)
    rows = rows.withColumn("u", unit_draw(F.lit(seed), F.lit("perm"), "win", "rep", "idx"))
    block = ["rep", "win", "half"]
    if largest <= sort_rows:
        by_draw = Window.partitionBy(*block).orderBy("u", "idx")
        return rows.withColumn("pos", F.row_number().over(by_draw) - 1)
    part = [*block, "part"]
    rows = rows.withColumn("part", F.floor(F.col("u") * F.ceil(F.col("n_block") / sort_rows)))
    earlier = Window.partitionBy(*block).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("n_part"))
        .select(*part, F.coalesce(F.sum("n_part").over(earlier), F.lit(0)).alias("before"))
    )
    by_draw = Window.partitionBy(*part).orderBy("u", "idx")
    return rows.join(offsets, part).withColumn("pos", F.col("before") + F.row_number().over(by_draw) - 1)


def permutation_replicates(indexed: DataFrame, replicates: int, seed: int, sort_rows: int = SORT_ROWS) -> DataFrame:
    """Coupled slope of every replicate with period-1 expected rates shuffled within blocks."""
    row = F.coalesce(F.col("blk_start") + F.col("pos"), F.lit(0))
    shuffled = shuffled_positions(indexed, replicates, seed, sort_rows).select("rep", "win", row.alias("row"), "xwoba_1")
    joined = shuffled.join(_lookup(indexed.select("row", "woba_1", "woba_2"), indexed.count()), "row")
    w1, x1, w2 = F.col("woba_1"), F.col("xwoba_1"), F.col("woba_2")
    return joined.groupBy("win", "rep").agg(F.regr_slope(w2 - w1, x1 - w1).alias("b_coupled"))


def permutation_null(indexed: DataFrame, replicates: int = 500, seed: int = 20260829) -> DataFrame:
    """The coupled slope under the null per window, and how rare the observed one is.

    Mean and upper 97.5% point, exact counts of replicates at least as high and
    at most as low as the observed slope, and from them the empirical chance
    ``(1 + count) / (1 + replicates)`` of each side and of both (twice the smaller
    one, at most 1). Windows without a defined observed slope have no chance.
    """
    # One row per window length.
    observed = F.broadcast(predictive_stats(indexed, ["win"]).select("win", F.col("b_coupled").alias("observed")))
    slope = F.col("b_coupled")
    chance = lambda count: F.when(F.col("observed").isNotNull(), (1 + F.col(count)) / (1 + F.col("n_perm")))
    return (
        permutation_replicates(indexed, replicates, seed)
        .join(observed, "win")
        .groupBy("win")
        .agg(
            F.count("b_coupled").alias("n_perm"),
            F.avg("b_coupled").alias("null_mean"),
            F.percentile("b_coupled", F.lit(0.975)).alias("null_hi"),
            F.max("observed").alias("observed"),
            F.count_if(slope >= F.col("observed")).alias("n_above"),
            F.count_if(slope <= F.col("observed")).alias("n_below"),
        )
        .withColumns({"p_above": chance("n_above"), "p_below": chance("n_below")})
        .withColumn("p_both", F.least(F.lit(1.0), 2 * F.least("p_above", "p_below")))
        .drop("observed")
    )
