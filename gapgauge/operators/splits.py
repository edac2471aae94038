"""Results by count, by type of pitch and by side.

All three take event rows with the columns of ``pa_level`` and a few more that a
source may lack; a column that is absent gives an empty result. Rows are summed
per entity and split first, so what is regrouped afterwards is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapgauge.functions import numeric
from gapgauge.operators.appearances import ROLES
from gapgauge.params import SignalParams

# Columns of the count, of the type of pitch and of the two sides.
COUNT_STATE = ("balls", "strikes")
PITCH_TYPE = "pitch_type"
SIDE = {"batter": "p_throws", "pitcher": "stand"}  # what the opponent does
LEFT, RIGHT = "L", "R"


def _values(events: DataFrame) -> tuple[Column, Column]:
    """Observed and expected value of a completed appearance, as in ``pa_level``."""
    types = {f.name: f.dataType for f in events.schema}
    value = F.coalesce(numeric("woba_value", types["woba_value"]), F.lit(0.0))
    expected = numeric("estimated_woba_using_speedangle", types["estimated_woba_using_speedangle"])
    return value, F.coalesce(expected, value)


def _empty(events: DataFrame, columns: str) -> DataFrame:
    return events.sparkSession.createDataFrame([], columns)


def _known(events: DataFrame, role: str) -> DataFrame:
    if role not in ROLES:
        raise ValueError(f"role must be one of {ROLES}, got {role!r}")
    return events.filter(F.col(role).isNotNull())


def count_state_splits(events: DataFrame, role: str = "batter") -> DataFrame:
    """Rates of completed appearances by (balls, strikes), with all totals.

    One row per entity and grouping set: both columns, each alone, none.
    ``level`` is the grouping id (0 both, 1 by balls, 2 by strikes, 3 the total)
    and tells a total from a count that is NULL.
    """
    balls, strikes = COUNT_STATE
    if not {balls, strikes} <= set(events.columns):
        return _empty(events, "pid bigint, balls int, strikes int, level int, n bigint, woba double, est_woba double, gap double")
    observed, expected = _values(events)
    cells = (
        _known(events, role)
        .filter(F.col("woba_denom") == 1)
        .groupBy(F.col(role).alias("pid"), F.col(balls).cast("int").alias(balls), F.col(strikes).cast("int").alias(strikes))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(observed).alias("w"), F.sum(expected).alias("x"))
    )
    sets = [["pid", balls, strikes], ["pid", balls], ["pid", strikes], ["pid"]]
    totals = cells.groupingSets(sets, "pid", balls, strikes).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("x").alias("x")
    )
    woba, est = F.col("w") / F.col("n"), F.col("x") / F.col("n")
    return totals.select("pid", balls, strikes, "level", "n", woba.alias("woba"), est.alias("est_woba"), (est - woba).alias("gap"))


def pitch_type_mix(events: DataFrame, role: str = "pitcher", type_shrink: int = 50, params: SignalParams = SignalParams()) -> DataFrame:
    """Per entity the share of every type of pitch and a rate shrunk in two steps.

    Shares are taken over all rows with a type. The rate of an entity is pulled
    toward that of the kind, the rate of a type toward that of the entity; the
    weights are so many appearances at the rate of the level above. Returns pid,
    n, rate and ``mix``, a map from type to (share, n_pa, rate). A kind without
    a completed appearance has no rates (NULL).
    """
    if PITCH_TYPE not in events.columns:
        return _empty(events, "pid bigint, n bigint, rate double, mix map<string, struct<share: double, n_pa: bigint, rate: double>>")
    kind_shrink = getattr(params, role).shrink_pa if role in ROLES else 0
    _, expected = _values(events)
    completed = F.col("woba_denom") == 1
    # A value that is NULL where no appearance ended is no part of the sum.
    cells = (
        _known(events, role)
        .filter(F.col(PITCH_TYPE).isNotNull())
        .groupBy(F.col(role).alias("pid"), F.col(PITCH_TYPE).cast("string").alias(PITCH_TYPE))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(completed).alias("n_pa"), F.coalesce(F.sum(F.when(completed, expected)), F.lit(0.0)).alias("x"))
    )
    entities = cells.groupBy("pid").agg(
        F.sum("n").alias("n"),
        F.sum("n_pa").alias("n_pa"),
        F.sum("x").alias("x"),
        # One element per type an entity uses.
        F.collect_list(F.struct(PITCH_TYPE, "n", "n_pa", "x")).alias("types"),
    )
    # A single row.
    kind = entities.agg(F.try_divide(F.sum("x"), F.sum("n_pa")).alias("kind_rate"))
    rate = (F.col("x") + F.col("kind_rate") * kind_shrink) / (F.col("n_pa") + kind_shrink)
    rated = entities.join(F.broadcast(kind)).withColumn("rate", rate)
    of_type = F.transform(
        F.array_sort("types"),
        lambda t: F.struct(
            t[PITCH_TYPE].alias("key"),
            F.struct(
                (t["n"] / F.col("n")).alias("share"),
                t["n_pa"].alias("n_pa"),
                ((t["x"] + F.col("rate") * type_shrink) / (t["n_pa"] + type_shrink)).alias("rate"),
            ).alias("value"),
        ),
    )
    return rated.select("pid", "n", "rate", F.map_from_entries(of_type).alias("mix"))


def _moments(side: str, value: Column) -> list[Column]:
    own = F.when(F.col("side") == side, value)
    return [F.count(own).alias(f"n_{side}"), F.avg(own).alias(f"mean_{side}"), F.var_samp(own).alias(f"var_{side}")]


PLATOON = "pid bigint, n_left bigint, n_right bigint, left_rate double, right_rate double, difference double, variance double, z double"


def platoon_splits(events: DataFrame, role: str = "batter") -> DataFrame:
    """Rate against left less rate against right of every entity, with variance and z.

    Both rates are of the same entity, so its level drops out. An entity that met
    one side only has no difference, one with a single appearance on a side no
    variance, and without variance there is no z (all NULL). Rows of an unknown
    side are left out.
    """
    if SIDE.get(role) not in events.columns:
        return _empty(events, PLATOON)
    observed, _ = _values(events)
    rows = _known(events, role).filter((F.col("woba_denom") == 1) & F.col(SIDE[role]).isin(LEFT, RIGHT))
    sides = rows.select(F.col(role).alias("pid"), F.col(SIDE[role]).alias("side"), observed.alias("value"))
    both = sides.groupBy("pid").agg(*_moments(LEFT, F.col("value")), *_moments(RIGHT, F.col("value")))
    difference = F.col("mean_L") - F.col("mean_R")
    variance = F.col("var_L") / F.nullif("n_L", F.lit(0)) + F.col("var_R") / F.nullif("n_R", F.lit(0))
    return both.select(
        "pid",
        F.col("n_L").alias("n_left"),
        F.col("n_R").alias("n_right"),
        F.col("mean_L").alias("left_rate"),
        F.col("mean_R").alias("right_rate"),
        difference.alias("difference"),
        variance.alias("variance"),
        (difference / F.sqrt(F.nullif(variance, F.lit(0.0)))).alias("z"),
    )


def platoon_summary(splits: DataFrame) -> DataFrame:
    """One row: the matched difference over all entities that met both sides.

    Entities count by the harmonic size of their two sides, with which each
    difference is weighted in a comparison within entities.
    """
    weight = F.col("n_left") * F.col("n_right") / (F.col("n_left") + F.col("n_right"))
    matched = splits.filter(F.col("variance").isNotNull()).withColumn("weight", weight)
    total = F.sum("weight")
    out = matched.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.try_divide(F.sum(F.col("weight") * F.col("difference")), total).alias("difference"),
        F.try_divide(F.sum(F.col("weight") * F.col("weight") * F.col("variance")), total * total).alias("variance"),
    )
    return out.withColumn("z", F.col("difference") / F.sqrt(F.nullif("variance", F.lit(0.0))))
