"""Declared schemas of the three fixed tables and the event columns in use."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
}


def table_schema(columns: str) -> T.StructType:
    """Schema from "name type, ..." text; needs no running session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[data_type]) for name, data_type in pairs])


# Table and column names.
EXPECTED_STATS = table_schema(
    "snapshot_date date, player_type string, player_id bigint, player_name string, year int, "
    "pa bigint, bip bigint, ba double, est_ba double, slg double, est_slg double, woba double, est_woba double"
)

BATTED_BALL = table_schema(
    "snapshot_date date, player_type string, player_id bigint, player_name string, attempts bigint, "
    "avg_hit_speed double, max_hit_speed double, avg_launch_angle double, barrels bigint, "
    "brl_percent double, brl_pa double, ev95percent double"
)

INGEST_LOG = table_schema("scope string, day date, rows bigint, fetched_at timestamp")

# The event table is open: these are only the columns the analysis reads.
EVENT_COLUMNS = table_schema(
    "batter bigint, pitcher bigint, game_date date, game_pk bigint, at_bat_number int, events string, "
    "estimated_woba_using_speedangle double, woba_value double, woba_denom int, "
    "launch_speed double, launch_angle double"
)
