"""Percentile ranks with averaged ties, without sorting a whole group in one task.

There are only two kinds of entity, so a window over the kind would sort half
of the table in a single task. The rank of a value needs only the number of
rows below it, so rows are first reduced to counts per distinct value. Those
are dealt to ranges that Spark takes from the data, and each value gets

    rows in lower ranges + rows at lower values of its range
    + (rows at the value + 1) / 2
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapgauge.session import cut_lineage


def _rows_before(sum_of: str, by: list[str], order: str) -> Column:
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(sum_of).over(window), F.lit(0))


def in_ranges(tallies: DataFrame, by: list[str]) -> DataFrame:
    """``tallies`` with ``part``, a number that grows with the value in its group.

    Written once, so that a task that runs again cannot change the ranges.
    """
    return cut_lineage(tallies.repartitionByRange(*by, "value").withColumn("part", F.spark_partition_id()))


def value_percentiles(ranged: DataFrame, by: list[str], min_rows: int) -> DataFrame:
    """Percentile of every distinct ``value`` given its number of rows ``n``.

    Groups of ``min_rows`` rows or fewer have no percentiles.
    """
    parts = ranged.groupBy(*by, "part").agg(F.sum("n").alias("n_part"))
    parts = parts.select(
        *by,
        "part",
        _rows_before("n_part", by, "part").alias("before_part"),
        F.sum("n_part").over(Window.partitionBy(*by)).alias("n_group"),
    )
    ranked = ranged.withColumn("before_value", _rows_before("n", [*by, "part"], "value")).join(parts, [*by, "part"])
    rank = F.col("before_part") + F.col("before_value") + (F.col("n") + 1) / F.lit(2.0)
    percentile = F.rint(rank / F.col("n_group") * 100)
    return ranked.filter(F.col("n_group") > min_rows).select(*by, "value", percentile.alias("percentile"))


def tie_averaged_percentiles(
    df: DataFrame, kind: str, ids: list[str], metrics: dict[str, tuple[Column, Column]], min_rows: int = 5
) -> DataFrame:
    """One row per entity that takes part, with a 0-100 percentile per metric.

    ``metrics`` maps an output name to (value, takes part); a value that is NULL
    or NaN never takes part. The result holds ``kind``, ``ids`` and the outputs.
    """
    entries = [
        F.when(takes_part & value.isNotNull() & ~F.isnan(value), F.struct(F.lit(name).alias("metric"), value.alias("value")))
        for name, (value, takes_part) in metrics.items()
    ]
    scored = df.select(kind, *ids, F.explode(F.array_compact(F.array(*entries))).alias("entry")).select(
        kind, *ids, "entry.metric", "entry.value"
    )
    by = [kind, "metric"]
    tallies = in_ranges(scored.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n")), by)
    return (
        scored.join(value_percentiles(tallies, by, min_rows), [*by, "value"])
        .groupBy(kind, *ids)
        .agg(*[F.max(F.when(F.col("metric") == name, F.col("percentile"))).alias(name) for name in metrics])
    )
