"""Closed-form statistics of paired periods and the verdict drawn from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def partial_beta(r_w: Column, r_x: Column, r_wx: Column, sd_w1: Column, sd_x1: Column, sd_w2: Column) -> Column:
    """Standardised coefficient of x1 in w2 ~ w1 + x1, from correlations.

    The cases without a unique solution take the shortest one, as a
    least-squares solver does.
    """
    rest = 1 - r_wx * r_wx
    return (
        F.when((sd_x1 == 0) | (sd_w2 == 0), F.lit(0.0))
        .when(sd_w1 == 0, r_x)
        .when(F.abs(rest) < 1e-12, r_x / 2)
        .otherwise((r_x - r_w * r_wx) / rest)
    )


def predictive_stats(pairs: DataFrame, keys: Iterable[str]) -> DataFrame:
    """How well period-1 rates predict the period-2 rate, one row per key.

    A single aggregate of moments; partial sums are merged per task before
    the shuffle.
    """
    keys = list(keys)
    w1, x1, w2 = F.col("woba_1"), F.col("xwoba_1"), F.col("woba_2")
    moments = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_samp(w1, w2).alias("c_w"),
        F.covar_samp(x1, w2).alias("c_x"),
        F.covar_samp(w1, x1).alias("c_wx"),
        F.stddev_samp(w1).alias("sd_w1"),
        F.stddev_samp(x1).alias("sd_x1"),
        F.stddev_samp(w2).alias("sd_w2"),
        F.regr_slope(w2 - w1, x1 - w1).alias("b_coupled"),
        F.sqrt(F.avg((w1 - w2) * (w1 - w2))).alias("rmse_w"),
        F.sqrt(F.avg((x1 - w2) * (x1 - w2))).alias("rmse_x"),
    )
    return _from_moments(moments, keys)


def weighted_predictive_stats(pairs: DataFrame, keys: Iterable[str], weight: str) -> DataFrame:
    """The same statistics where every pair counts ``weight`` times (a whole number).

    The rates should be centred, as ``poisson_replicates`` does it, since the
    moments are differences of sums. ``n`` is the sum of the weights; keys with
    fewer than two have no moments (NULL).
    """
    keys = list(keys)
    names = {"w1": "woba_1", "x1": "xwoba_1", "w2": "woba_2"}
    of = {k: F.col(c) for k, c in names.items()}
    weighted = F.col(weight)
    crossed = [("w1", "w1"), ("x1", "x1"), ("w2", "w2"), ("w1", "x1"), ("w1", "w2"), ("x1", "w2")]
    sums = pairs.groupBy(*keys).agg(
        F.sum(weighted).alias("n"),
        *[F.sum(weighted * v).alias(f"s_{k}") for k, v in of.items()],
        *[F.sum(weighted * of[a] * of[b]).alias(f"s_{a}{b}") for a, b in crossed],
    )
    n = F.col("n")

    def covariance(a: str, b: str) -> Column:
        both = f"s_{a}{b}" if (a, b) in crossed else f"s_{b}{a}"
        return (F.col(both) - F.col(f"s_{a}") * F.col(f"s_{b}") / n) / F.nullif(n - 1, F.lit(0))

    def spread(a: str) -> Column:
        return F.sqrt(F.greatest(covariance(a, a), F.lit(0.0)))

    def distance(a: str) -> Column:
        square = F.col(f"s_{a}{a}") - 2 * F.col(f"s_{a}w2") + F.col("s_w2w2")
        return F.sqrt(F.greatest(square / n, F.lit(0.0)))

    # Slope of w2 - w1 on x1 - w1.
    rise = covariance("x1", "w2") - covariance("w1", "w2") - covariance("w1", "x1") + covariance("w1", "w1")
    run = covariance("x1", "x1") - 2 * covariance("w1", "x1") + covariance("w1", "w1")
    moments = sums.filter(n > 0).select(
        *keys,
        "n",
        covariance("w1", "w2").alias("c_w"),
        covariance("x1", "w2").alias("c_x"),
        covariance("w1", "x1").alias("c_wx"),
        spread("w1").alias("sd_w1"),
        spread("x1").alias("sd_x1"),
        spread("w2").alias("sd_w2"),
        _ratio(rise, run).alias("b_coupled"),
        distance("w1").alias("rmse_w"),
        distance("x1").alias("rmse_x"),
    )
    return _from_moments(moments, keys)


def _from_moments(moments: DataFrame, keys: list[str]) -> DataFrame:
    sd_w1, sd_x1, sd_w2 = F.col("sd_w1"), F.col("sd_x1"), F.col("sd_w2")
    correlated = moments.withColumns(
        {
            "r_w": _ratio(F.col("c_w"), sd_w1 * sd_w2),
            "r_x": _ratio(F.col("c_x"), sd_x1 * sd_w2),
            "r_wx": _ratio(F.col("c_wx"), sd_w1 * sd_x1),
        }
    )
    r_w, r_x, r_wx = F.col("r_w"), F.col("r_x"), F.col("r_wx")
    return correlated.select(
        *keys,
        "n",
        "sd_w1",
        "sd_x1",
        "r_w",
        "r_x",
        (r_x - r_w).alias("dr"),
        partial_beta(r_w, r_x, r_wx, sd_w1, sd_x1, sd_w2).alias("b_partial"),
        "b_coupled",
        "rmse_w",
        "rmse_x",
    )


def verdict(dr_lo: Column, dr_hi: Column, n_blocks: Column, few_blocks: int = 3) -> Column:
    """A winner only where the interval of the difference excludes zero.

    The texts are fixed values.
    """
    text = (
        F.when(dr_lo.isNull(), "inconclusive")
        .when(dr_lo > 0, "xwOBA wins")
        .when(dr_hi < 0, "wOBA wins")
        .otherwise("no evidence")
    )
    note = F.when(n_blocks < few_blocks, F.concat(F.lit(" (only "), n_blocks.cast("string"), F.lit(" blk)")))
    return F.concat(text, F.coalesce(note, F.lit("")))
