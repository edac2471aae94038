"""Text files whose lines may be malformed: good rows apart from damaged ones.

A line is set aside, with its file and the reason, if it has another number of
fields than the header, if it cannot be read at all, or if a value is none of
its column's type. Nothing is cut, filled or turned to NULL to make a line fit.

The type of a CSV column comes from its values: a kind of type (number, date,
truth value) is taken if nearly all values are of it, and within the kind the
narrowest that holds all of them, so a few damaged values do not turn a column
into text. A column that the table already holds as something else than text
stays what it is unless more than half of its values disagree.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapgauge.sources.events import DAY_COLUMN, INGEST_DAY
from gapgauge.sources.landing import day_folder, read_folders
from gapgauge.sources.paths import exists, has_data_files, remove_folder
from gapgauge.sources.widening import common_type

LINE = "_malformed_line"
REJECTED = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("file", "reason", "field", "record")] + [T.StructField(INGEST_DAY, T.DateType())]
)
# A field in quotes, with a quote inside escaped or doubled.
QUOTED = r'"(?:[^"\\]|\\.|"")*"'


@dataclass(frozen=True)
class DamageParams:
    # Share of a column's values that may disagree with its kind of type.
    tolerance: float = 0.05
    # The same for a column whose type is known, and share of malformed lines
    # beyond which a day fails as a whole and is asked for again.
    most: float = 0.5


@dataclass(frozen=True)
class SortedRows:
    """Rows of some days with equal columns, and those set aside; both carry ``day``."""

    days: list[date]
    good: DataFrame
    rejected: DataFrame


def _is(cell: Column, data_type: str) -> Column:
    """Whether a text is a value of the type."""
    value = cell.try_cast(data_type)
    if data_type == "double":  # Java takes a type suffix for a number
        value = F.when(~cell.rlike("[0-9.][dDfF]\\s*$"), value)
    if data_type == "decimal(38,0)":
        value = F.when(cell.rlike("^\\s*[+-]?[0-9]+\\s*$"), value)
    if data_type == "date":  # a cast would cut the time off
        value = F.when(cell.rlike("^\\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\\s*$"), value)
    return value.isNotNull()


# Each kind from narrow to wide; the widest decides whether a text is of the kind.
KINDS = {
    "number": ("bigint", "decimal(38,0)", "double"),
    "time": ("date", "timestamp"),
    "truth": ("boolean",),
}


def _kind_of(data_type: str) -> str | None:
    if data_type == "int" or data_type.startswith("decimal"):
        return "number"
    return next((k for k, types in KINDS.items() if data_type in types), None)


def _kinds(known: str | None) -> dict[str, tuple[str, ...]]:
    """Kinds to try: all for a new column, its own for a known one, none for text."""
    if known is None:
        return KINDS
    kind = _kind_of(known)
    return {kind: KINDS[kind]} if kind else {}


def _counts(i: int, cell: Column, known: str | None) -> list[Column]:
    tests = [F.count_if(_is(cell, t)).alias(f"c{i}_{k}_{j}") for k, types in _kinds(known).items() for j, t in enumerate(types)]
    return [F.count(cell).alias(f"c{i}_n"), *tests]


def _type_of(i: int, row, known: str | None, p: DamageParams) -> str:
    """Narrowest type of the kind that nearly all values of column ``i`` belong to."""
    n = row[f"c{i}_n"]
    if not n:  # nothing to go by, and nothing to store
        return known or "void"
    for k, types in _kinds(known).items():
        fits = [row[f"c{i}_{k}_{j}"] for j in range(len(types))]
        if fits[-1] and n - fits[-1] <= (p.most if known else p.tolerance) * n:
            return next(t for t, fit in zip(types, fits, strict=True) if fit == fits[-1])
    return "string"


def _raw(spark: SparkSession, landing: str, days: Iterable[date], header: list[str]) -> DataFrame:
    """Cells as text, the whole line where it does not fit the header, file and day."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*header, LINE)])
    rows = (
        spark.read.schema(schema)
        # A file whose header differs makes its day fail instead of shifting columns.
        .options(header="true", mode="PERMISSIVE", columnNameOfCorruptRecord=LINE, enforceSchema="false", basePath=landing)
        .csv([day_folder(landing, d) for d in days])
    )
    cells = F.struct(*[F.col(f"`{c}`").alias(c) for c in header]).alias("cells")
    return rows.select(cells, F.col(LINE).alias("line"), F.col("day").cast("date").alias("day"), F.col("_metadata.file_path").alias("file"))


def _cell(name: str) -> Column:
    return F.col("cells").getField(name)


def _line_reason(width: int) -> Column:
    fields = F.size(F.split(F.regexp_replace("line", QUOTED, "q"), ",", -1))
    damaged = F.when(fields < width, "missing fields").when(fields > width, "surplus fields").otherwise("unreadable line")
    return F.when(F.col("line").isNotNull(), damaged)


def _sorted(raw: DataFrame, header: list[str], types: tuple[str, ...], days: list[date]) -> SortedRows:
    def fits(name: str, t: str) -> Column:
        cell = _cell(name)
        if name.lower() == DAY_COLUMN:
            return _is(cell.substr(1, 10), "date")
        return F.lit(True) if t in ("string", "void") else _is(cell, t)

    wrong = [F.when(_cell(c).isNotNull() & ~fits(c, t), F.lit(c)) for c, t in zip(header, types, strict=True)]
    judged = raw.withColumn("wrong", F.concat_ws(",", *wrong)).withColumn(
        "reason", F.coalesce(_line_reason(len(header)), F.when(F.col("wrong") != "", "unreadable value"))
    )
    def value(name: str, t: str) -> Column:
        return F.lit(None) if t == "void" else _cell(name).cast("string" if name.lower() == DAY_COLUMN else t)

    good = judged.filter(F.col("reason").isNull()).select(*[value(c, t).alias(c) for c, t in zip(header, types, strict=True)], "day")
    rejected = judged.filter(F.col("reason").isNotNull()).select(
        "file",
        "reason",
        F.when(F.col("line").isNull(), F.col("wrong")).alias("field"),
        F.coalesce("line", F.to_csv("cells")).alias("record"),
        F.col("day").alias(INGEST_DAY),
    )
    return SortedRows(days, good, rejected)


def read_csv_days(
    spark: SparkSession, landing: str, days: Iterable[date], known: dict[str, str], p: DamageParams = DamageParams()
) -> list[SortedRows]:
    """Days of CSV files, those with the same columns and types together.

    ``known`` has the types of the table's columns. Raises ValueError for days of
    which too many lines are malformed.
    """
    by_header: dict[tuple[str, ...], list[date]] = {}
    for day in days:
        if has_data_files(spark, day_folder(landing, day)):
            header = spark.read.option("header", "true").csv(day_folder(landing, day)).columns
            if header:
                by_header.setdefault(tuple(header), []).append(day)
    seen = []
    for header, same in by_header.items():
        raw = _raw(spark, landing, same, list(header))
        sound = F.col("line").isNull()
        counts = [x for i, c in enumerate(header) for x in _counts(i, F.when(sound, _cell(c)), known.get(c.lower()))]
        # One row per day: as many columns as the header has, times the types tried.
        rows = raw.groupBy("day").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~sound).alias("bad"), *counts).collect()
        seen.extend((row["day"], header, row) for row in rows)
    alike: dict[tuple, list[date]] = {}
    for day, header, row in sorted(seen, key=lambda x: x[0]):
        if row["bad"] > p.most * row["rows"]:
            raise ValueError(f"{row['bad']} of {row['rows']} lines of {day} are malformed")
        types = tuple(_type_of(i, row, known.get(c.lower()), p) for i, c in enumerate(header))
        alike.setdefault((header, types), []).append(day)
        # What an earlier day has settled holds for the later ones.
        known = known | {c.lower(): common_type({known.get(c.lower(), t), t}) for i, (c, t) in enumerate(zip(header, types, strict=True)) if row[f"c{i}_n"]}
    return [_sorted(_raw(spark, landing, own, list(header)), list(header), types, own) for (header, types), own in alike.items()]


def read_json_days(spark: SparkSession, landing: str, days: Iterable[date], p: DamageParams = DamageParams()) -> list[SortedRows]:
    """Days of JSON lines; a line that is no JSON object is set aside."""
    out = []
    for day in days:
        if not has_data_files(spark, day_folder(landing, day)):
            continue
        reader = spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=LINE, basePath=landing)
        schema = reader.json(day_folder(landing, day)).drop("day").schema
        names = [f.name for f in schema.fields if f.name != LINE]
        if not names and not schema.fields:
            continue
        if not names:
            raise ValueError(f"no line of {day} is a JSON object")
        if LINE not in schema.names:
            schema = T.StructType([*schema.fields, T.StructField(LINE, T.StringType())])
        rows = reader.schema(schema).json(day_folder(landing, day)).withColumn("file", F.col("_metadata.file_path"))
        bad = F.col(LINE).isNotNull()
        count = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad"), *[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(names)]).first()
        if count["bad"] > p.most * count["rows"]:
            raise ValueError(f"{count['bad']} of {count['rows']} lines of {day} are malformed")
        record = F.coalesce(F.col(LINE), F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])))
        rejected = rows.filter(bad).select(
            "file", F.lit("unreadable line").alias("reason"), F.lit(None).cast("string").alias("field"), record.alias("record"), F.col("day").cast("date").alias(INGEST_DAY)
        )
        out.append(SortedRows([day], rows.filter(~bad).select(*[F.col(f"`{c}`") for c in names], "day"), rejected))
    return out


def replace_rejected(rejected: DataFrame, days: Iterable[date], path: str) -> None:
    """Store what was set aside of some days in place of what was before."""
    for day in days:
        remove_folder(rejected.sparkSession, f"{path.rstrip('/')}/{INGEST_DAY}={day.isoformat()}")
    rejected.hint("rebalance", INGEST_DAY).write.mode("append").partitionBy(INGEST_DAY).parquet(path)


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """Lines set aside: file, reason, field, record, ingest_day."""
    if not exists(spark, path):
        return spark.createDataFrame([], REJECTED)
    return spark.read.schema(REJECTED).parquet(path)
