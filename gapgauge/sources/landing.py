"""Landed source files: one folder per day, each with its own set of columns."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gapgauge.sources.paths import has_data_files

# Files of one day may differ too, so their schemas are merged.
READ_OPTIONS = {
    "parquet": {"mergeSchema": "true"},
    "csv": {"header": "true", "inferSchema": "true"},
}


def day_folder(landing: str, day: date) -> str:
    return f"{landing.rstrip('/')}/day={day.isoformat()}"


def read_folders(
    spark: SparkSession, landing: str, days: Iterable[date], fmt: str, schema: T.StructType | None = None
) -> DataFrame:
    """Rows of the days' folders with the folder's day in the column ``day``."""
    reader = spark.read.options(**READ_OPTIONS.get(fmt, {})).option("basePath", landing).format(fmt)
    return (reader.schema(schema) if schema else reader).load([day_folder(landing, d) for d in days])


def read_landing_day(spark: SparkSession, landing: str, day: date, fmt: str = "parquet") -> DataFrame | None:
    """All columns of one day's files, or None where nothing landed."""
    if not has_data_files(spark, day_folder(landing, day)):
        return None
    return read_folders(spark, landing, [day], fmt).drop("day")


def days_by_schema(
    spark: SparkSession, landing: str, days: Iterable[date], fmt: str
) -> list[tuple[T.StructType, list[date]]]:
    """Days that can be read together, with their common schema.

    One look at all footers usually gives one schema for all days. Where types
    clash every day is looked at by itself. Text files are read by ``damaged``.
    """
    landed = [d for d in days if has_data_files(spark, day_folder(landing, d))]
    if not landed:
        return []
    if fmt == "parquet":
        try:
            return [(read_folders(spark, landing, landed, fmt).drop("day").schema, landed)]
        except PySparkException:
            pass  # clashing types or a damaged file: find out by day
    alike: dict[str, tuple[T.StructType, list[date]]] = {}
    for day in landed:
        schema = read_folders(spark, landing, [day], fmt).drop("day").schema
        if schema.fields:
            alike.setdefault(schema.json(), (schema, []))[1].append(day)
    return list(alike.values())
