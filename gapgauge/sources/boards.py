"""The two leaderboards: column mapping, source minimum, snapshot storage."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapgauge import schemas
from gapgauge.functions import display_name, null_if_nan
from gapgauge.params import CONTACT_BOARD_MINIMUM, EXPECTED_BOARD_MINIMUM

# Columns that are named differently in the source.
CONTACT_RENAMES = {"avg_launch_angle": "avg_hit_angle"}


def _typed(source: DataFrame, name: str, data_type: T.DataType) -> Column:
    """The source column in the table's type; NULL if absent or not convertible."""
    if name not in source.columns:
        return F.lit(None).cast(data_type)
    if isinstance(data_type, T.DoubleType):
        return null_if_nan(F.col(name).try_cast(data_type))
    return F.col(name).try_cast(data_type)


def project_board(
    source: DataFrame,
    schema: T.StructType,
    kind: str,
    snapshot: date,
    year: int | None = None,
    renames: dict[str, str] | None = None,
) -> DataFrame:
    """Map a source board to the table's columns; absent columns become NULL."""
    fixed = {
        "snapshot_date": F.lit(snapshot).cast("date"),
        "player_type": F.lit(kind),
        "player_name": display_name(source.columns),
        "year": F.lit(year).cast("int"),
    }
    renames = renames or {}
    return source.select(
        *[
            (fixed[f.name] if f.name in fixed else _typed(source, renames.get(f.name, f.name), f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def _at_least(source: DataFrame, name: str, minimum: int) -> DataFrame:
    """Rows that reach the minimum; a cell that is no number does not."""
    if name not in source.columns:
        return source
    number = F.col(name)
    if not isinstance(source.schema[name].dataType, T.NumericType):
        number = number.try_cast("double")
    return source.filter(number >= minimum)


def load_expected_board(
    source: DataFrame, kind: str, snapshot: date, year: int, minimum: int = EXPECTED_BOARD_MINIMUM
) -> DataFrame:
    """Expected-rate board of one kind, entities below the minimum left out."""
    kept = _at_least(source, "pa", minimum)
    return project_board(kept, schemas.EXPECTED_STATS, kind, snapshot, year)


def load_contact_board(
    source: DataFrame, kind: str, snapshot: date, minimum: int = CONTACT_BOARD_MINIMUM
) -> DataFrame:
    """Contact-quality board of one kind, entities below the minimum left out."""
    kept = _at_least(source, "attempts", minimum)
    return project_board(kept, schemas.BATTED_BALL, kind, snapshot, renames=CONTACT_RENAMES)


def one_per_entity(board: DataFrame, keys: list[str], sample: str) -> DataFrame:
    """The row with the largest sample of every key; ties go by the other columns, in order.

    Partial maxima are merged, so a key that is repeated very often costs one
    row per task.
    """
    rest = [c for c in board.columns if c not in (*keys, sample)]
    present = [sample] if sample in board.columns else []
    best = board.groupBy(*keys).agg(F.max(F.struct(*present, *rest)).alias("best"))
    return best.select(*[c if c in keys else F.col(f"best.{c}").alias(c) for c in board.columns])


def replace_snapshot(board: DataFrame, path: str) -> None:
    """Write a board; a second run for the same date and kind replaces the first.

    (snapshot_date, player_type, player_id) is a key of the stored table: of an
    entity's repeated rows the one with the largest sample is kept. Rows without
    an id refer to nobody and are kept as they are. Only the partitions present
    in ``board`` are overwritten. Rows are gathered by partition first, so a
    snapshot is a few files, and a large one is split over several tasks by
    entity.
    """
    keys = ["snapshot_date", "player_type"]
    known = F.col("player_id").isNotNull()
    unique = one_per_entity(board.filter(known), [*keys, "player_id"], "pa" if "pa" in board.columns else "attempts")
    (
        unique.unionByName(board.filter(~known))
        .hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def read_board(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.names)
