"""Column expressions shared by the operators. All run inside codegen."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def as_column(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c: ColumnLike) -> Column:
    """NaN compares as the largest value in Spark, so it never enters a table."""
    return F.nanvl(as_column(c), F.lit(None).cast("double"))


def numeric(c: ColumnLike, data_type: T.DataType) -> Column:
    """A double, or NULL where the cell is no number.

    Java accepts a type suffix ("1d", "2f") that is no number in a data file.
    """
    col = as_column(c)
    if isinstance(data_type, T.StringType):
        col = F.when(~col.rlike("[0-9.][dDfF]\\s*$"), col).try_cast("double")
    return null_if_nan(col.cast("double"))


def numeric_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Coerce the named columns; whole numbers are numbers already."""
    types = {f.name: f.dataType for f in df.schema.fields}
    loose = [n for n in names if n in types and not isinstance(types[n], T.IntegralType)]
    return df.withColumns({n: numeric(n, types[n]) for n in loose}) if loose else df


def _stripped(c: ColumnLike) -> Column:
    return F.trim(as_column(c), F.lit(" \t\n\r"))


def display_name(columns: Iterable[str]) -> Column:
    """Readable name from whichever of the four name layouts a source has."""
    present = set(columns)
    if "last_name, first_name" in present:
        parts = F.split(F.col("`last_name, first_name`"), ",")
        return _stripped(F.array_join(F.reverse(parts), " "))
    if {"first_name", "last_name"} <= present:
        return F.concat(_stripped("first_name"), F.lit(" "), _stripped("last_name"))
    if "last_name" in present:
        return F.col("last_name")
    return F.lit("unknown")


def season_bounds(game_date: ColumnLike, year: int) -> Column:
    """Whole calendar year as a range, so that date partitions are pruned."""
    return as_column(game_date).between(F.lit(date(year, 1, 1)), F.lit(date(year, 12, 31)))


def unit_draw(*parts: ColumnLike) -> Column:
    """Repeatable uniform number in [0, 1) made from the given parts.

    A lost task that is run again draws the same numbers, which a stateful
    generator would not. 48 bits of a digest fit a double exactly.
    """
    text = F.concat_ws("|", *[as_column(p).cast("string") for p in parts])
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10)
    return digits.cast("double") * F.lit(2.0**-48)
