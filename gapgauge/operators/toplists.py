"""Bounded best/worst lists per kind and the full ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first_n(df: DataFrame, n: int, order: Column) -> DataFrame:
    # The filter on row_number lets Spark keep only n rows per kind in every
    # task before the shuffle, so the two-valued key is no bottleneck.
    window = Window.partitionBy("player_type").orderBy(order, "player_id")
    return df.withColumn("position", F.row_number().over(window)).filter(F.col("position") <= n)


def top_n(signals: DataFrame, n: int) -> DataFrame:
    """The n largest outlooks of each kind; NULLs only fill up a short list."""
    return _first_n(signals.filter("qualified"), n, F.col("outlook").desc_nulls_last())


def bottom_n(signals: DataFrame, n: int) -> DataFrame:
    """The n smallest outlooks of each kind."""
    return _first_n(signals.filter("qualified"), n, F.col("outlook").asc_nulls_last())


def ranked_all(signals: DataFrame) -> DataFrame:
    """All qualified entities by expected rate, best first within each kind."""
    return signals.filter("qualified").orderBy("player_type", F.col("est_woba").desc_nulls_last(), "player_id")


def trend_entities(signals: DataFrame, n: int) -> DataFrame:
    """Entities whose trend is reported: first n of both lists, per kind."""
    picked = top_n(signals, n).unionByName(bottom_n(signals, n)).select("player_type", "player_id")
    return picked.filter(F.col("player_id") != 0).distinct()
