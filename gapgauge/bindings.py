"""Domain views over the general-purpose test tables.

The test tables hold no performance data, so line items stand for appearances:
suppliers bat, parts pitch. All rates are whole multiples of a power of two
and therefore sum exactly in any order, which lets two engines agree to the
last digit.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapgauge.functions import display_name
from gapgauge.params import ReportParams, SignalParams, StudyParams, TrendParams
from gapgauge.schemas import BATTED_BALL, EXPECTED_STATS
from gapgauge.session import cut_lineage

EARLY, LATE = date(1998, 12, 31), date(2001, 12, 31)

# Gates that fit the test tables, where a pitcher has about 30 appearances.
SIGNALS = SignalParams().with_min_pa(batter=150, pitcher=20)
STUDY = StudyParams(windows=(180, 360, 720), min_pa=20, bootstrap=50, permutations=50)
# A study within one year has room for short windows only.
STUDY_YEAR, SHORT_WINDOWS = 2000, (30, 60, 120)
TRENDS = TrendParams(window=50, days=None)
REPORT = ReportParams(signals=SIGNALS, trend=TRENDS)
CONTACT_MINIMUM = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows in the layout the analysis reads."""
    return table(spark, sf_dir, "lineitem").select(*_pitch_columns())


def detailed_pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with count, type of pitch and the sides of both entities.

    Some strikes, types and sides are unknown, and some pitchers and batters meet
    one side only.
    """
    types = F.array(*[F.lit(t) for t in ("FF", "SL", "CH", "CU")])
    return table(spark, sf_dir, "lineitem").select(
        *_pitch_columns(),
        (F.col("l_linenumber") % 4).alias("balls"),
        F.when(F.col("l_quantity") <= 48, F.col("l_quantity").cast("int") % 3).alias("strikes"),
        F.when(F.col("l_orderkey") % 5 < 4, F.get(types, (F.col("l_orderkey") % 5).cast("int"))).alias("pitch_type"),
        F.when(F.col("l_partkey") % 50 == 0, "R").when(F.col("l_suppkey") % 3 == 0, "L").otherwise("R").alias("stand"),
        F.when(F.col("l_suppkey") % 10 == 0, F.when(F.col("l_quantity") > 25, "L"))
        .when(F.col("l_partkey") % 3 == 0, "L")
        .otherwise("R")
        .alias("p_throws"),
    )


def _pitch_columns() -> list[Column]:
    contact = F.col("l_returnflag") != "R"
    return [
        F.col("l_suppkey").alias("batter"),
        F.col("l_partkey").alias("pitcher"),
        F.col("l_shipdate").cast("date").alias("game_date"),
        F.col("l_orderkey").alias("game_pk"),
        F.col("l_linenumber").alias("at_bat_number"),
        F.col("l_returnflag").alias("events"),
        F.when(contact, F.round(F.col("l_discount") * 100).cast("int") * 41 / F.lit(1024.0)).alias(
            "estimated_woba_using_speedangle"
        ),
        F.when(F.col("l_quantity") <= 48, F.round(F.col("l_tax") * 100).cast("int") * 13 / F.lit(256.0)).alias(
            "woba_value"
        ),
        F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), 0).otherwise(1).alias("woba_denom"),
        F.when(contact, F.col("l_quantity") + 60).alias("launch_speed"),
        F.when(contact, F.col("l_linenumber") * F.lit(5.0)).alias("launch_angle"),
    ]


def _entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed appearances once per role, with the values of both rates."""
    value = F.coalesce("woba_value", F.lit(0.0))
    roles = F.array(
        F.struct(F.lit("batter").alias("player_type"), F.col("batter").alias("player_id")),
        F.struct(F.lit("pitcher").alias("player_type"), F.col("pitcher").alias("player_id")),
    )
    return (
        pitches(spark, sf_dir)
        .filter(F.col("woba_denom") == 1)
        .select(
            F.explode(roles).alias("entity"),
            "game_date",
            value.alias("woba"),
            F.coalesce("estimated_woba_using_speedangle", value).alias("est_woba"),
            "estimated_woba_using_speedangle",
            "launch_speed",
            "launch_angle",
        )
        .select("entity.*", "*")
        .drop("entity")
    )


def _snapshots(spark: SparkSession, sf_dir: str, **measures: tuple) -> DataFrame:
    """Season-to-date measures at both cut-offs, from one scan and one shuffle."""
    aggregates = []
    for label, cutoff in (("early", EARLY), ("late", LATE)):
        inside = F.col("game_date") <= F.lit(cutoff)
        for name, (aggregate, value) in measures.items():
            aggregates.append(aggregate(F.when(inside, value)).alias(f"{label}_{name}"))
    grouped = _entity_rows(spark, sf_dir).groupBy("player_type", "player_id").agg(*aggregates)

    def snapshot(label: str, cutoff: date) -> Column:
        return F.struct(
            F.lit(cutoff).alias("snapshot_date"), *[F.col(f"{label}_{n}").alias(n) for n in measures]
        )

    both = F.explode(F.array(snapshot("early", EARLY), snapshot("late", LATE)))
    return grouped.select("player_type", "player_id", both.alias("s")).select("player_type", "player_id", "s.*")


def board_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything both boards are made of."""
    speed = F.col("launch_speed")
    return _snapshots(
        spark,
        sf_dir,
        pa=(F.count, F.lit(1)),
        bip=(F.count, F.col("estimated_woba_using_speedangle")),
        woba=(F.avg, F.col("woba")),
        est_woba=(F.avg, F.col("est_woba")),
        attempts=(F.count, speed),
        avg_hit_speed=(F.avg, speed),
        max_hit_speed=(F.max, speed),
        avg_launch_angle=(F.avg, F.col("launch_angle")),
        barrels=(F.count, F.when(speed >= 105, 1)),
        hard=(F.count, F.when(speed >= 95, 1)),
    ).withColumn("player_name", F.concat(F.col("player_type"), F.lit(" "), F.col("player_id").cast("string")))


def as_expected(measures: DataFrame) -> DataFrame:
    derived = measures.filter(F.col("pa") > 0).withColumns(
        {
            "year": F.year("snapshot_date"),
            "ba": F.col("woba") * 0.8,
            "est_ba": F.col("est_woba") * 0.8,
            "slg": F.col("woba") * 1.4,
            "est_slg": F.col("est_woba") * 1.4,
        }
    )
    return derived.select(*EXPECTED_STATS.names)


def as_contact(measures: DataFrame) -> DataFrame:
    """Entities with few contacts are absent, as at the source."""
    derived = measures.filter(F.col("attempts") >= CONTACT_MINIMUM).withColumns(
        {
            "brl_percent": 100 * F.col("barrels") / F.col("attempts"),
            "brl_pa": 100 * F.col("barrels") / F.col("pa"),
            "ev95percent": 100 * F.col("hard") / F.col("attempts"),
        }
    )
    return derived.select(*BATTED_BALL.names)


def expected_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_expected(board_measures(spark, sf_dir))


def boards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both boards, aggregated from the events once and written.

    Boards are stored tables in use. The analysis reads them several times,
    which must not mean scanning the events several times.
    """
    measures = cut_lineage(board_measures(spark, sf_dir))
    return as_expected(measures), as_contact(measures)


def board_source(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A leaderboard as the source sends it: own column names, a column missing.

    Batters come with a combined name column, pitchers with two columns.
    """
    rows = pitches(spark, sf_dir).filter(F.col("woba_denom") == 1)
    value = F.coalesce("woba_value", F.lit(0.0))
    speed = F.col("launch_speed")
    board = rows.groupBy(F.col(kind).alias("player_id")).agg(
        F.count(F.lit(1)).alias("pa"),
        F.count("estimated_woba_using_speedangle").alias("bip"),
        F.avg(value).alias("woba"),
        F.avg(F.coalesce("estimated_woba_using_speedangle", value)).alias("est_woba"),
        F.count(speed).alias("attempts"),
        F.avg(speed).alias("avg_hit_speed"),
        F.max(speed).alias("max_hit_speed"),
        F.avg("launch_angle").alias("avg_hit_angle"),
        F.count_if(speed >= 105).alias("barrels"),
    )
    number = F.col("player_id").cast("string")
    if kind == "batter":
        return board.withColumn("last_name, first_name", F.concat(F.lit("Supplier, Number "), number))
    return board.withColumns({"last_name": F.concat(F.lit("Part "), number), "first_name": F.lit(" Number ")})


def name_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four name layouts, each over the whole customer table."""
    customer = table(spark, sf_dir, "customer")
    return {
        "combined": customer.select("c_custkey", F.concat_ws(", ", "c_mktsegment", "c_name").alias("last_name, first_name")),
        "separate": customer.select(
            "c_custkey", F.concat(F.lit(" "), "c_mktsegment").alias("first_name"), F.col("c_name").alias("last_name")
        ),
        "last_only": customer.select("c_custkey", F.col("c_name").alias("last_name")),
        "none": customer.select("c_custkey"),
    }


def named(source: DataFrame, layout: str) -> DataFrame:
    return source.select("c_custkey", F.lit(layout).alias("layout"), display_name(source.columns).alias("player_name"))
