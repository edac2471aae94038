"""The event table: every source column is kept, and the columns may drift.

Data lie in Parquet partitioned by the day of ingest, which alone decides what a
repeated run replaces. ``game_date`` is data, sorted inside the files, so that
filters on it skip row groups by their statistics. A small column registry
beside it names each logical column and its type, so a read passes an explicit
schema and no file footers have to be merged. A column that is absent from an
older file reads as NULL.

Names are compared without regard to case. A column may come back with another
type (bigint, then double, then text): its values go into a physical column of
that type (``name__double``), so nothing is converted when it is written, and
reading puts the physical columns together in a type that holds all of them
without loss (``sources.widening``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapgauge.schemas import table_schema
from gapgauge.sources.paths import exists
from gapgauge.sources.widening import EXACT_IN_DOUBLE, common_type, physical_name, storage_type, wider_type

__all__ = ["append_days", "column_changes", "normalize_event_date", "read_events", "read_registry", "storage_type", "stringify_exotic", "wider_type"]

DAY_COLUMN = "game_date"
INGEST_DAY = "ingest_day"
INGEST_BATCH = "ingest_batch"
# Order inside a file, so that row groups hold few entities each, and columns with
# a Bloom filter, by which a reader that looks for some entities skips row groups.
CLUSTER_BY = ("batter", "pitcher")
# Different entities a row group's filter is made for; 20 KB for each column.
ENTITIES_PER_GROUP = 16_384
# ``large`` marks a physical column with whole numbers that no double holds.
REGISTRY = table_schema("name string, physical string, type string, large boolean")


def registry_path(path: str) -> str:
    return path.rstrip("/") + "_columns"


def normalize_event_date(df: DataFrame, column: str = DAY_COLUMN) -> DataFrame:
    """The day as a date, whatever text or timestamp the source sent."""
    return df.withColumn(column, F.to_date(F.col(column).cast("string").substr(1, 10)))


def stringify_exotic(df: DataFrame) -> DataFrame:
    """Lists, maps and structs as JSON text; scalar columns stay as they are."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    exotic = {f.name: F.to_json(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, nested)}
    return df.withColumns(exotic) if exotic else df


def column_changes(registry: dict[str, dict[str, str]], batch: DataFrame) -> tuple[list[tuple[str, str, str]], dict[str, str]]:
    """Registry rows to add for a batch, and the physical column of each batch column.

    ``registry`` maps a logical name to its physical columns and their types. A
    name that differs from a known one in case only is that column.
    """
    added, placed = [], {}
    known = {name.lower(): name for name in registry}
    taken = {p for columns in registry.values() for p in columns} | {DAY_COLUMN, INGEST_DAY, INGEST_BATCH}
    for f in batch.schema.fields:
        stored = storage_type(f.dataType)
        if stored is None or f.name.lower() in (DAY_COLUMN, INGEST_DAY, INGEST_BATCH):
            continue
        name = known.get(f.name.lower(), f.name)
        columns = registry.get(name, {})
        holder = next((p for p, t in columns.items() if t == stored), None)
        if holder is None:
            holder = physical_name(name, stored if columns else "", taken)
            taken.add(holder)
            added.append((name, holder, stored))
        placed[f.name] = holder
    return added, placed


def _registered(spark: SparkSession, path: str) -> list:
    if not exists(spark, registry_path(path)):
        return []
    return spark.read.schema(REGISTRY).json(registry_path(path)).distinct().orderBy("name", "physical").collect()


def _by_name(rows: list) -> dict[str, dict[str, str]]:
    known: dict[str, dict[str, str]] = {}
    for r in rows:
        known.setdefault(r["name"], {})[r["physical"]] = r["type"]
    return known


def _large(rows: list) -> set[str]:
    return {r["physical"] for r in rows if r["large"]}


def read_registry(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """Logical name -> {physical name: type}. One row per column ever seen."""
    return _by_name(_registered(spark, path))


def _register(spark: SparkSession, path: str, added: list[tuple[str, str, str]], large: bool = False) -> None:
    if added:
        spark.createDataFrame([(*row, large) for row in added], REGISTRY).coalesce(1).write.mode("append").json(registry_path(path))


def _bloom_options(physical: list[str]) -> dict[str, str]:
    options = {f"parquet.bloom.filter.enabled#{p}": "true" for p in physical}
    return options | {f"parquet.bloom.filter.expected.ndv#{p}": str(ENTITIES_PER_GROUP) for p in physical}


def append_days(batch: DataFrame, path: str, batch_id: int | None = None) -> int:
    """Write the batch's days of ingest; one that is already there is replaced.

    A batch without the column ``ingest_day`` is stored by ``game_date``; rows
    without a date then go with the last day of the batch, and a batch without
    any date is refused. Returns the number of rows written, counted by the
    writing tasks. With ``batch_id`` the days are added to and only what the
    same batch wrote before is replaced; a table is written one way or the other.

    New columns widen the table, absent ones read as NULL. The registry is
    extended before the data are written: an entry without data is harmless,
    data without an entry would be invisible. Rows are gathered by day first,
    and a large day is split over several tasks.
    """
    spark = batch.sparkSession
    batch = stringify_exotic(normalize_event_date(batch))
    if INGEST_DAY not in batch.columns:
        last = batch.agg(F.max(DAY_COLUMN)).first()[0]
        undated = F.raise_error(F.lit("rows without a date need the column ingest_day")).cast("date")
        batch = batch.withColumn(INGEST_DAY, F.coalesce(DAY_COLUMN, undated if last is None else F.lit(last)))
    known = _registered(spark, path)
    registry, large = _by_name(known), _large(known)
    added, placed = column_changes(registry, batch)
    _register(spark, path, added)
    for name, physical, stored_type in added:
        registry.setdefault(name, {})[physical] = stored_type
    types = {p: (name, t) for name, columns in registry.items() for p, t in columns.items()}
    stored = batch.select(
        F.col(INGEST_DAY).cast("date").alias(INGEST_DAY),
        F.col(DAY_COLUMN),
        *[F.col(f"`{name}`").cast(types[physical][1]).alias(physical) for name, physical in placed.items()],
    )
    parts = [INGEST_DAY]
    if batch_id is not None:
        stored, parts = stored.withColumn(INGEST_BATCH, F.lit(batch_id).cast("bigint")), [INGEST_DAY, INGEST_BATCH]
    clustering = [c for c in (*parts, DAY_COLUMN, *CLUSTER_BY) if c in stored.columns]
    whole = [p for p in placed.values() if types[p][1] == "bigint" and p not in large]
    beyond = [F.count_if((F.col(f"`{p}`") > EXACT_IN_DOUBLE) | (F.col(f"`{p}`") < -EXACT_IN_DOUBLE)) for p in whole]
    entities = [p for p in placed.values() if types[p][0].lower() in CLUSTER_BY]
    written = Observation()
    (
        stored.hint("rebalance", INGEST_DAY)
        .sortWithinPartitions(*clustering)
        .observe(written, F.count(F.lit(1)).alias("rows"), *[c.alias(f"large_{i}") for i, c in enumerate(beyond)])
        .write.mode("overwrite")
        .options(partitionOverwriteMode="dynamic", **_bloom_options(entities))
        .partitionBy(*parts)
        .parquet(path)
    )
    # A run that stops here is repeated, since its days are not in the ledger yet.
    seen = written.get
    _register(spark, path, [(types[p][0], p, "bigint") for i, p in enumerate(whole) if seen[f"large_{i}"]], large=True)
    return seen["rows"]


def _logical(name: str, columns: dict[str, str], large: set[str]) -> Column:
    widest = common_type(columns.values(), any(p in large for p in columns))
    return F.coalesce(*[F.col(f"`{p}`").cast(widest) for p in columns]).alias(name)


def logical_types(spark: SparkSession, path: str) -> dict[str, str]:
    """Type each column of the table is read as, by its name in lower case."""
    known = _registered(spark, path)
    large = _large(known)
    return {name.lower(): common_type(c.values(), any(p in large for p in c)) for name, c in _by_name(known).items()}


def read_events(spark: SparkSession, path: str, ingest_day: bool = False) -> DataFrame:
    """The whole table with its logical columns, on request with the day of ingest."""
    known = _registered(spark, path)
    registry, large = _by_name(known), _large(known)
    stored = [f"`{p}` {t}" for columns in registry.values() for p, t in columns.items()]
    raw = spark.read.schema(", ".join([*stored, f"`{DAY_COLUMN}` date", f"`{INGEST_DAY}` date"])).parquet(path)
    days = [DAY_COLUMN, INGEST_DAY] if ingest_day else [DAY_COLUMN]
    return raw.select(*[_logical(name, columns, large) for name, columns in registry.items()], *days)
