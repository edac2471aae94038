"""One query per operator, each over whole tables.

Floating results are rounded to nine digits, so that a different order of
summation does not show.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapgauge import bindings as b
from gapgauge import operators as op
from gapgauge import plans, schemas, sources
from gapgauge.functions import numeric
from gapgauge.operators import resampling, signals as sg, toplists
from gapgauge.operators.appearances import recent_days
from gapgauge.plans.report import json_record, null_safe
from gapgauge.session import cut_lineage, shared_folder
from gapgauge.sources.events import DAY_COLUMN
from gapgauge.sources.landing import day_folder
from gapgauge.sources.ledger import latest_entries, ledger_entries
from gapgauge.sources.paths import make_folder
from gapgauge.streaming import dedup_stream, ingest_stream

SHIFT = 3e-11
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to ``digits`` digits, without a negative zero.

    The rates are multiples of powers of two and often lie exactly half way
    between two results; a small shift moves them off that point.
    """
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(c) + SHIFT, digits) + F.lit(0.0) for c in doubles}) if doubles else df


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables a query writes, below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def all_signals(spark: SparkSession, sf: str) -> DataFrame:
    return op.build_signals(*b.boards(spark, sf), b.SIGNALS)


def latest_gapped(spark: SparkSession, sf: str) -> DataFrame:
    expected, _ = b.boards(spark, sf)
    return sg.with_gaps(sg.at_snapshot(expected), b.SIGNALS)


def with_contact(spark: SparkSession, sf: str) -> DataFrame:
    expected, contact = b.boards(spark, sf)
    return sg.attach_contact(sg.with_gaps(sg.at_snapshot(expected), b.SIGNALS), sg.at_snapshot(contact))


def calibrated(spark: SparkSession, sf: str) -> DataFrame:
    gapped = latest_gapped(spark, sf)
    return sg.calibrate(gapped, sg.pool_calibration(gapped, b.SIGNALS), b.SIGNALS)


def appearances(spark: SparkSession, sf: str, role: str = "batter", **filters) -> DataFrame:
    return op.pa_level(b.pitches(spark, sf), role, **filters)


def dated_events(spark: SparkSession, sf: str) -> DataFrame:
    return b.table(spark, sf, "events").withColumn(DAY_COLUMN, F.col("ts").cast("date"))


def last_day(events: DataFrame) -> date:
    return events.agg(F.max(DAY_COLUMN)).first()[0]


def day_rows(spark: SparkSession, sf: str) -> DataFrame:
    return b.pitches(spark, sf).groupBy(F.col("game_date").alias("day")).agg(F.count(F.lit(1)).alias("rows"))


def full_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days with at least the mean number of rows; they stand for ingested days."""
    counts = day_rows(spark, sf)
    return counts.filter(F.col("rows") >= counts.agg(F.avg("rows")).scalar())


def last_season(spark: SparkSession, sf: str) -> DataFrame:
    end = last_day(b.pitches(spark, sf))
    return sources.season_calendar(spark, end.year, through=end)


# Sources and ingest


@query
def scan_events_day(spark, sf):
    events = dated_events(spark, sf)
    return rounded(events.filter(F.col(DAY_COLUMN) == events.agg(F.max(DAY_COLUMN)).scalar()))


@query
def load_expected_board(spark, sf):
    kinds = [
        sources.load_expected_board(b.board_source(spark, sf, kind), kind, b.LATE, b.LATE.year, minimum)
        for kind, minimum in (("batter", 50), ("pitcher", b.SIGNALS.pitcher.min_pa))
    ]
    return rounded(kinds[0].unionByName(kinds[1]))


@query
def load_contact_board(spark, sf):
    kinds = [
        sources.load_contact_board(b.board_source(spark, sf, kind), kind, b.LATE, minimum)
        for kind, minimum in (("batter", 30), ("pitcher", b.CONTACT_MINIMUM))
    ]
    return rounded(kinds[0].unionByName(kinds[1]))


@query
def season_calendar(spark, sf):
    return (
        last_season(spark, sf)
        .join(day_rows(spark, sf), "day", "left")
        .select("day", F.coalesce("rows", F.lit(0)).alias("rows"))
    )


@query
def pending_days(spark, sf):
    return sources.pending_days(last_season(spark, sf), full_days(spark, sf))


@query
def pending_days_newest(spark, sf):
    """The ten newest pending days: newest first with a limit."""
    return sources.pending_days(last_season(spark, sf), full_days(spark, sf), newest_first=True, limit_days=10)


@query
def normalize_event_date(spark, sf):
    events = b.table(spark, sf, "events").select("event_id", F.col("ts").cast("string").alias(DAY_COLUMN))
    return sources.normalize_event_date(events)


@query
def stringify_exotic(spark, sf):
    events = b.table(spark, sf, "events").select(
        "event_id",
        F.array("user_id", "event_id").alias("pair"),
        F.struct("user_id", "event_type").alias("origin"),
        "event_type",
    )
    return sources.stringify_exotic(events)


@query
def append_with_drift(spark, sf):
    """First half of the days without ``props`` and with whole values, then all columns."""
    events = dated_events(spark, sf)
    path = f"{scratch(spark, 'drift')}/events"
    early = F.col(DAY_COLUMN) <= F.lit(date(2024, 1, 15))
    first = events.filter(early).withColumn("value", F.floor("value")).drop("props")
    second = events.filter(~early).withColumn("extra", F.col("user_id") + 1)
    sources.append_days(first, path)
    sources.append_days(second, path)
    return rounded(sources.read_events(spark, path))


@query
def append_lossless(spark, sf):
    """Three thirds of January: other types, other spellings, numbers that no double holds."""
    events = dated_events(spark, sf)
    path, day = f"{scratch(spark, 'lossless')}/events", F.day(DAY_COLUMN)
    large = F.col("event_id") + F.lit((1 << 53) + 1)
    batches = (
        (day <= 10, {"big": large, "Money": F.col("value").cast("decimal(10,2)"), "whole": F.col("user_id").cast("int"), "extra": F.col("user_id")}),
        ((day > 10) & (day <= 20), {"BIG": F.col("value"), "money": F.col("value").cast("decimal(12,3)"), "whole": F.col("user_id"), "Extra": F.col("user_id") + 1}),
        (day > 20, {"Big": large, "MONEY": F.col("user_id"), "Whole": F.col("value"), "EXTRA": F.lit(None)}),
    )
    for part, columns in batches:
        sources.append_days(events.filter(part).select("event_id", "ts", "props", DAY_COLUMN, *[c.alias(n) for n, c in columns.items()]), path)
    table = sources.read_events(spark, path)
    return rounded(table.select("event_id", "ts", "props", DAY_COLUMN, "big", F.col("money").cast("string").alias("money"), "whole", "extra"))


@query
def ledger_upsert(spark, sf):
    """Hourly entries per event type and day; the last one stands."""
    entries = (
        dated_events(spark, sf)
        .groupBy(F.col("event_type").alias("scope"), F.col(DAY_COLUMN).alias("day"), F.hour("ts").alias("hour"))
        .agg(F.count(F.lit(1)).alias("rows"), F.max("ts").alias("fetched_at"))
        .drop("hour")
    )
    return latest_entries(entries)


@query
def empty_day_marking(spark, sf):
    return ledger_entries(full_days(spark, sf), last_season(spark, sf)).drop("fetched_at")


def ingest_paths(spark: SparkSession, name: str) -> plans.IngestPaths:
    root = scratch(spark, name)
    return plans.IngestPaths(f"{root}/landing", f"{root}/events", f"{root}/ledger")


def land(events: DataFrame, paths: plans.IngestPaths, day: str = DAY_COLUMN) -> None:
    by_day = events.withColumn("day", F.col(day)).hint("rebalance", F.col("day"))
    by_day.write.mode("append").partitionBy("day").parquet(paths.landing)


def landed(spark: SparkSession, sf: str, name: str) -> plans.IngestPaths:
    paths = ingest_paths(spark, name)
    land(dated_events(spark, sf), paths)
    return paths


def ingest_january(spark: SparkSession, paths: plans.IngestPaths, fmt: str = "parquet") -> dict:
    """January and a day more stand for the season of this table."""
    return plans.daily_ingest(spark, paths, 2024, through=date(2024, 2, 1), season_start={2024: "2024-01-01"}, fmt=fmt)


@query
def daily_ingest(spark, sf):
    """Land all events by day, ingest them, and go on two days past the data."""
    paths = landed(spark, sf, "daily")
    for offset in range(32):  # a folder without data is a day without events
        make_folder(spark, day_folder(paths.landing, date(2024, 1, 1) + timedelta(offset)))
    ingest_january(spark, paths)
    stored = (
        sources.read_events(spark, paths.events)
        .groupBy(F.col(DAY_COLUMN).alias("day"))
        .agg(F.sum("value").alias("value"), F.count_distinct("user_id").alias("users"))
    )
    ledger = sources.read_ledger(spark, paths.ledger).drop("fetched_at")
    return rounded(ledger.join(stored, "day", "left"), 6)


def land_damaged_csv(spark: SparkSession, sf: str, paths: plans.IngestPaths) -> None:
    """Events as CSV by day; every 50th line is cut, has fields too many, or a user that is no number."""
    events = dated_events(spark, sf)
    quoted = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"'))
    cells = [F.col("event_id").cast("string"), F.col("ts").cast("string"), F.col("user_id").cast("string"), F.col("event_type"), F.col("value").cast("string"), quoted]
    way = F.when(F.col("event_id") % 50 == 0, F.col("event_id") % 3)
    unreadable = [F.lit("n/a") if i == 2 else c for i, c in enumerate(cells)]
    line = (
        F.when(way == 0, F.concat_ws(",", *cells[:3]))
        .when(way == 1, F.concat_ws(",", *cells, F.lit("more"), F.lit("")))
        .when(way == 2, F.concat_ws(",", *unreadable))
        .otherwise(F.concat_ws(",", *cells))
    )
    day = F.col(DAY_COLUMN).alias("day")
    lines = events.select(day, F.lit(1).alias("place"), "event_id", line.alias("line"))
    headers = events.select(day, F.lit(0).alias("place"), F.lit(0).cast("bigint").alias("event_id"), F.lit("event_id,ts,user_id,event_type,value,props").alias("line")).distinct()
    ordered = lines.unionByName(headers).repartition("day").sortWithinPartitions("day", "place", "event_id")
    ordered.select("day", "line").write.partitionBy("day").text(paths.landing)


@query
def daily_ingest_damaged(spark, sf):
    """Rows that could be read, and what was set aside by day, reason and field."""
    paths = ingest_paths(spark, "damaged")
    land_damaged_csv(spark, sf, paths)
    ingest_january(spark, paths, "csv")
    stored = sources.read_events(spark, paths.events)
    aside = plans.rejected_counts(spark, paths).groupBy(F.col("ingest_day").alias(DAY_COLUMN), "reason", "field").agg(F.sum("rows").alias("rows"))
    return rounded(stored.unionByName(aside, allowMissingColumns=True).select("event_id", "ts", "user_id", "event_type", "value", "props", DAY_COLUMN, "reason", "field", "rows"))


@query
def daily_ingest_misdated(spark, sf):
    """Every tenth row is dated a day later than the folder it landed in; a run is repeated."""
    paths = ingest_paths(spark, "misdated")
    events = dated_events(spark, sf).withColumn("landed_on", F.col(DAY_COLUMN))
    shifted = F.when(F.col("event_id") % 10 == 0, F.date_add(DAY_COLUMN, 1)).otherwise(F.col(DAY_COLUMN))
    land(events.withColumn(DAY_COLUMN, shifted), paths, "landed_on")
    ingest_january(spark, paths)
    plans.ingest_days(spark, paths, [date(2024, 1, d) for d in range(1, 11)])
    stored = sources.read_events(spark, paths.events)
    return rounded(stored.select("event_id", "ts", "user_id", "event_type", "value", "props", "landed_on", DAY_COLUMN))


@query
def late_landing(spark, sf):
    """A third of the days lands between two runs, one of the batch and one of the stream."""
    events = dated_events(spark, sf)
    late = F.day(DAY_COLUMN) % 3 == 0
    batch, stream = ingest_paths(spark, "late"), ingest_paths(spark, "late-stream")
    checkpoint = scratch(spark, "late-checkpoint")
    for part in (~late, late):
        for paths in (batch, stream):
            land(events.filter(part), paths)
        ingest_january(spark, batch)
        ingest_stream(spark, stream, checkpoint).awaitTermination()
    stored = [
        sources.read_events(spark, paths.events).select(F.lit(way).alias("way"), "event_id", "event_type", DAY_COLUMN)
        for way, paths in (("batch", batch), ("stream", stream))
    ]
    return stored[0].unionByName(stored[1])


@query
def stream_ingest(spark, sf):
    """The same through the stream over the landing folder."""
    paths = landed(spark, sf, "stream")
    ingest_stream(spark, paths, f"{scratch(spark, 'stream-checkpoint')}").awaitTermination()
    return rounded(sources.read_events(spark, paths.events).select("event_id", "ts", "user_id", "event_type", "value", "props", DAY_COLUMN))


@query
def stream_dedup(spark, sf):
    """All events land twice in other files, the second time under other days; every event is stored once."""
    paths, checkpoint = ingest_paths(spark, "dedup"), scratch(spark, "dedup-checkpoint")
    number = F.col("event_id")
    keyed = dated_events(spark, sf).withColumns({"game_pk": F.floor(number / 100), "at_bat_number": F.floor(number / 10) % 10, "pitch_number": number % 10})
    for run in (0, 1):
        shuffled = keyed.repartition(5, F.xxhash64("event_id", F.lit(run))).withColumn("day", F.date_add(DAY_COLUMN, run))
        # The first time two thirds come, then all of them.
        come = shuffled.filter(F.lit(bool(run)) | (number % 3 > 0))
        come.write.mode("append").partitionBy("day").parquet(paths.landing)
        dedup_stream(spark, paths, checkpoint, keyed.schema, event_time="ts", delay="60 days").awaitTermination()
    table = sources.read_events(spark, paths.events)
    return rounded(table.select("event_id", "ts", "user_id", "event_type", "value", "props", DAY_COLUMN))


@query
def replace_snapshot(spark, sf):
    """A snapshot written twice on one date holds the second run only."""
    path = f"{scratch(spark, 'board')}/expected_stats"
    board, _ = b.boards(spark, sf)
    sources.replace_snapshot(board.withColumn("pa", F.lit(0).cast("bigint")), path)
    sources.replace_snapshot(board.filter(F.col("player_type") == "batter"), path)
    return rounded(sources.read_board(spark, path, schemas.EXPECTED_STATS))


@query
def snapshot_ingest(spark, sf):
    path = f"{scratch(spark, 'snapshot')}/batted_ball"
    plans.snapshot_ingest(
        lambda kind: b.board_source(spark, sf, kind), path, b.LATE, b.LATE.year, board="contact", minimum=b.CONTACT_MINIMUM
    )
    return rounded(sources.read_board(spark, path, schemas.BATTED_BALL))


def with_repeats(board: DataFrame) -> DataFrame:
    """Every entity twice; the copy has one attempt more where the id is even, else one less."""
    more = F.when(F.col("player_id") % 2 == 0, 1).otherwise(-1)
    copy = board.withColumns({"attempts": F.col("attempts") + more, "avg_hit_speed": F.col("avg_hit_speed") + 1})
    return board.unionByName(copy)


@query
def snapshot_ingest_repeated(spark, sf):
    """A source that repeats entities; the row with more attempts is stored."""
    path = f"{scratch(spark, 'repeated')}/batted_ball"
    plans.snapshot_ingest(
        lambda kind: with_repeats(b.board_source(spark, sf, kind)), path, b.LATE, b.LATE.year, board="contact", minimum=b.CONTACT_MINIMUM
    )
    return rounded(sources.read_board(spark, path, schemas.BATTED_BALL).select("player_type", "player_id", "attempts", "avg_hit_speed", "barrels"))


@query
def display_name(spark, sf):
    layouts = [b.named(source, layout) for layout, source in b.name_sources(spark, sf).items()]
    first, *rest = layouts
    for layout in rest:
        first = first.unionByName(layout)
    return first


@query
def latest_snapshot(spark, sf):
    return sg.latest_snapshot(b.expected_stats(spark, sf))


@query
def snapshot_per_kind(spark, sf):
    """The last snapshot has pitchers only; batters are taken from the one before."""
    path = f"{scratch(spark, 'kinds')}/expected_stats"
    board = b.expected_stats(spark, sf)
    sources.replace_snapshot(board.filter((F.col("snapshot_date") == F.lit(b.EARLY)) | (F.col("player_type") == "pitcher")), path)
    stored = sources.read_board(spark, path, schemas.EXPECTED_STATS)
    signals = op.build_signals(stored, None, b.SIGNALS, per_kind=True)
    return rounded(signals.select("snapshot_date", *sg.ENTITY, "pa", "luck_gap", "luck_z", "flagged", "pct_woba"))


@query
def scan_snapshot(spark, sf):
    return rounded(sg.at_snapshot(b.expected_stats(spark, sf), b.EARLY))


@query
def null_safe_json(spark, sf):
    joined = with_contact(spark, sf)
    return joined.select("player_type", "player_id", json_record(["player_id", "player_name", "attempts"]).alias("record"))


@query
def null_safe_values(spark, sf):
    """Every value of every record, read back from JSON; some doubles were NaN."""
    odd = with_contact(spark, sf).select(*sg.ENTITY, "player_name", "pa", "woba", "est_woba", "luck_gap", "avg_hit_speed", "brl_percent", "qualified")
    nan = {c: F.when((F.col("player_id") + i) % 4 == 0, float("nan")).otherwise(F.col(c)) for i, c in enumerate(("woba", "est_woba", "luck_gap", "avg_hit_speed"))}
    safe = null_safe(odd.withColumns(nan))
    record = json_record(safe.columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in safe.schema.fields)
    return rounded(safe.select(F.from_json(record, schema, {"mode": "FAILFAST", "allowNonNumericNumbers": "false"}).alias("r")).select("r.*"))


# Projections and filters


@query
def numeric_coerce(spark, sf):
    """Quantities as text: plain, padded, or with a letter that makes them no number."""
    q = F.col("l_quantity").cast("int").cast("string")
    text = (
        F.when(F.col("l_returnflag") == "N", q)
        .when(F.col("l_returnflag") == "A", F.concat(q, F.lower("l_linestatus")))
        .otherwise(F.concat(F.lit(" "), q, F.lit(" ")))
    )
    items = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text"))
    return items.withColumn("number", numeric("text", T.StringType()))


@query
def drop_incomplete(spark, sf):
    """Daily boards whose rates are NULL on days without contact; one kind is unknown."""
    kind = F.when(F.col("events") == "A", "batter").when(F.col("events") == "N", "pitcher").otherwise("runner")
    board = (
        b.pitches(spark, sf)
        .groupBy(kind.alias("player_type"), F.col("batter").alias("player_id"), "game_date")
        .agg(
            F.count(F.lit(1)).alias("pa"),
            F.count("estimated_woba_using_speedangle").alias("bip"),
            F.avg("woba_value").alias("woba"),
            F.avg("estimated_woba_using_speedangle").alias("est_woba"),
        )
        .withColumns({c: F.lit(None).cast("double") for c in ("ba", "est_ba", "slg", "est_slg")})
    )
    kept = sg.with_gaps(board, b.SIGNALS)
    return rounded(kept.select("player_type", "player_id", "game_date", "pa", "woba", "est_woba", "luck_gap"))


@query
def gaps(spark, sf):
    return rounded(latest_gapped(spark, sf).select(*sg.ENTITY, "luck_gap", "ba_gap", "slg_gap", "qualified"))


@query
def flags(spark, sf):
    return rounded(calibrated(spark, sf).select(*sg.ENTITY, "luck_z", "outlook", "qualified", "flagged", "direction"))


@query
def shrink_projection(spark, sf):
    return rounded(calibrated(spark, sf).select(*sg.ENTITY, "league_mean_est_woba", "proj_woba_ros", "proj_vs_current"))


@query
def pa_level(spark, sf):
    return appearances(spark, sf).drop("opponent")


@query
def pa_level_pitcher_year(spark, sf):
    """Pitchers in one calendar year."""
    return appearances(spark, sf, "pitcher", year=2000).drop("opponent")


@query
def recent_days_filter(spark, sf):
    """Appearances of the 120 days before the end of the data."""
    events = b.pitches(spark, sf)
    return op.pa_level(events, "batter", days=120, as_of=last_day(events)).drop("opponent")


@query
def entity_semi(spark, sf):
    """Appearances of the flagged batters only."""
    flagged = all_signals(spark, sf).filter("flagged and player_type = 'batter'").select("player_id")
    return op.pa_level(b.pitches(spark, sf), "batter", ids=flagged).drop("opponent")


# Joins, aggregates and ranks of the boards


@query
def attach_contact(spark, sf):
    return rounded(with_contact(spark, sf).select(*sg.ENTITY, *sg.CONTACT_COLUMNS))


@query
def attach_contact_repeated(spark, sf):
    """The join with a board that repeats its entities adds no rows."""
    expected, contact = b.boards(spark, sf)
    joined = sg.attach_contact(sg.with_gaps(sg.at_snapshot(expected), b.SIGNALS), with_repeats(sg.at_snapshot(contact)))
    return rounded(joined.select(*sg.ENTITY, *sg.CONTACT_COLUMNS))


@query
def pool_calibration(spark, sf):
    return rounded(sg.pool_calibration(latest_gapped(spark, sf), b.SIGNALS))


@query
def pct_rank_avg(spark, sf):
    return op.tie_averaged_percentiles(latest_gapped(spark, sf), "player_type", ["player_id"], sg.rate_metrics())


@query
def pct_rank_contact(spark, sf):
    return op.tie_averaged_percentiles(with_contact(spark, sf), "player_type", ["player_id"], sg.contact_metrics())


@query
def pct_rank_events(spark, sf):
    """Percentile of every event's value within its type."""
    events = b.table(spark, sf, "events")
    return op.tie_averaged_percentiles(
        events, "event_type", ["event_id"], {"pct_value": (F.col("value"), F.lit(True))}
    )


@query
def pct_rank_wide(spark, sf):
    """The same for prices and for large whole numbers, nearly all of them different."""
    orders = b.table(spark, sf, "orders").select(
        "o_orderstatus",
        "o_orderkey",
        F.col("o_totalprice").alias("price"),
        (F.col("o_orderkey").cast("bigint") * F.col("o_custkey") * 1000003).cast("double").alias("wide"),
    )
    metrics = {"pct_price": (F.col("price"), F.lit(True)), "pct_wide": (F.col("wide"), F.lit(True))}
    return op.tie_averaged_percentiles(orders, "o_orderstatus", ["o_orderkey"], metrics)


@query
def signals(spark, sf):
    return rounded(all_signals(spark, sf))


@query
def signal_checks(spark, sf):
    return op.signal_checks(all_signals(spark, sf), b.SIGNALS)


LISTED = ["player_type", "player_id", "position", "outlook", "luck_z", "proj_woba_ros", "direction"]


@query
def breakout_top_n(spark, sf):
    return rounded(op.top_n(calibrated(spark, sf), b.REPORT.top_n).select(*LISTED))


@query
def regression_top_n(spark, sf):
    return rounded(op.bottom_n(calibrated(spark, sf), b.REPORT.top_n).select(*LISTED))


@query
def ranked_all(spark, sf):
    return rounded(op.ranked_all(calibrated(spark, sf)).select(*sg.ENTITY, "est_woba", "woba"))


@query
def trend_entity_pick(spark, sf):
    return toplists.trend_entities(calibrated(spark, sf), b.REPORT.trend_n)


@query
def group_summary(spark, sf):
    return rounded(plans.group_summary(calibrated(spark, sf)))


@query
def report_rows(spark, sf):
    return rounded(plans.report_rows(all_signals(spark, sf).filter("qualified")))


def whole_report(spark: SparkSession, sf: str) -> DataFrame:
    stamp = datetime(2001, 12, 31, tzinfo=timezone.utc)
    return plans.build_report(all_signals(spark, sf), b.pitches(spark, sf), b.LATE.year, b.REPORT, generated_at=stamp)


ENTRY = (
    "player_id bigint, player_name string, player_type string, pa bigint, bip bigint, ba double, est_ba double, slg double, est_slg double, "
    "woba double, est_woba double, luck_gap double, luck_z double, outlook double, proj_woba_ros double, proj_vs_current double, "
    "pct_est_woba double, pct_woba double, pct_ev double, pct_barrel double, pct_hardhit double, avg_hit_speed double, brl_percent double, "
    "ev95percent double, avg_launch_angle double, qualified boolean, flagged boolean, direction string"
)
POINTS = "array<struct<d: date, pa: bigint, x: double, w: double, ev: double>>"


def parsed(line: str, schema: str):
    """What a line of the document holds, without the comma in front."""
    return F.from_json(F.regexp_replace(line, "^[ ,]+", ""), schema, {"mode": "FAILFAST"})


@query
def report_entries(spark, sf):
    """Every entry of every list of the report, read back from its line."""
    lines = whole_report(spark, sf).filter("section = 1 and part in (1, 3, 5)")
    place = F.when(F.col("part") < 5, F.col("sort_key").cast("int")).alias("place")
    return rounded(lines.select("kind_no", "part", place, parsed("line", ENTRY).alias("e")).select("kind_no", "part", "place", "e.*"))


@query
def report_trends(spark, sf):
    """Every point of the report's trends, read back from the lines."""
    lines = whole_report(spark, sf).filter("section = 2 and kind_no >= 0 and part = 1")
    cut = lines.select("kind_no", F.regexp_extract("line", '"([0-9]+)": (.*)$', 1).cast("bigint").alias("pid"),
                       F.regexp_extract("line", '"([0-9]+)": (.*)$', 2).alias("points"))
    return cut.select("kind_no", "pid", F.explode(parsed("points", POINTS)).alias("p")).select("kind_no", "pid", "p.*")


@query
def refresh_pipeline(spark, sf):
    """A whole refresh: boards, 30 days of landed events, report; its entries and the ledger."""
    store = plans.Store(scratch(spark, "refresh"))
    events = b.pitches(spark, sf)
    end = last_day(events)
    start = end - timedelta(29)
    for offset in range(30):
        make_folder(spark, day_folder(store.ingest.landing, start + timedelta(offset)))
    land(events.filter(F.col("game_date") >= F.lit(start)), store.ingest)
    failed = plans.refresh(
        spark, store, lambda kind: b.board_source(spark, sf, kind), lambda kind: b.board_source(spark, sf, kind), end.year,
        snapshot=b.LATE, params=b.REPORT, as_of=end, through=end, days_back=30,
    )
    if any(failed.values()):
        raise RuntimeError(f"the refresh left out {failed}")
    lines = spark.read.text(store.at("report")).filter(F.col("value").rlike('^ {8},?\\{"player_id"'))
    entries = lines.select(parsed("value", ENTRY).alias("e")).select("e.*").groupBy("player_type", "player_id").agg(
        F.count(F.lit(1)).alias("times"), *[F.max(c).alias(c) for c in ("player_name", "pa", "woba", "est_woba", "luck_z", "outlook", "proj_woba_ros", "pct_woba", "pct_ev")]
    )
    days = sources.read_ledger(spark, store.ingest.ledger).select("day", F.col("rows").alias("times"), F.lit("ledger").alias("player_type"))
    return rounded(entries.unionByName(days, allowMissingColumns=True))


@query
def report_document(spark, sf):
    """Lines of every part of the report."""
    return whole_report(spark, sf).groupBy("section", "kind_no", "part").agg(F.count(F.lit(1)).alias("n_lines"))


# Trends


@query
def entity_ordinals(spark, sf):
    return op.entity_ordinals(appearances(spark, sf)).select(
        "pid", "game_date", "game_pk", "at_bat_number", "opponent", "ordinal", "n_rows"
    )


@query
def rolling_mean_rows(spark, sf):
    rows = op.rolling_means(appearances(spark, sf), b.TRENDS)
    return rounded(rows.select("pid", "game_date", "ordinal", "x_roll", "w_roll"))


@query
def rolling_mean_hot(spark, sf):
    """One entity owns a third of all appearances; those of large entities are numbered and averaged in pieces."""
    events = b.pitches(spark, sf)
    hot = events.withColumn("batter", F.when(F.col("game_pk") % 3 == 0, F.lit(0)).otherwise(F.col("batter")))
    rows = op.rolling_means(op.pa_level(hot, "batter"), b.TRENDS, sort_rows=1000, segment_rows=500)
    return rounded(rows.select("pid", "game_date", "ordinal", "n_rows", "x_roll", "w_roll", "ev_roll"))


@query
def rolling_mean_sparse(spark, sf):
    rows = op.rolling_means(appearances(spark, sf, "pitcher"), b.TRENDS)
    return rounded(rows.select("pid", "game_date", "ordinal", "ev_roll"))


@query
def rolling_trends(spark, sf):
    """All points of all batters."""
    trends = op.rolling_trends(b.pitches(spark, sf), None, "batter", b.TRENDS)
    return trends.select("pid", F.explode("points").alias("p")).select("pid", "p.*")


@query
def flagged_trends(spark, sf):
    """Points of the pitchers the report lists."""
    picked = toplists.trend_entities(calibrated(spark, sf), b.REPORT.trend_n).filter("player_type = 'pitcher'")
    trends = op.rolling_trends(b.pitches(spark, sf), picked.select("player_id"), "pitcher", b.TRENDS)
    return trends.select("pid", F.explode("points").alias("p")).select("pid", "p.*")


# Splits


@query
def count_state_splits(spark, sf):
    """Every batter by balls and strikes, with totals."""
    return rounded(op.count_state_splits(b.detailed_pitches(spark, sf)))


@query
def pitch_type_mix(spark, sf):
    """Shares and shrunk rates of every pitcher's types of pitch."""
    mix = op.pitch_type_mix(b.detailed_pitches(spark, sf))
    types = mix.select("pid", "n", "rate", F.explode("mix").alias("pitch_type", "of_type"))
    return rounded(types.select("pid", "n", "rate", "pitch_type", "of_type.share", "of_type.n_pa", F.col("of_type.rate").alias("type_rate")))


def all_platoon_splits(spark: SparkSession, sf: str) -> DataFrame:
    events = b.detailed_pitches(spark, sf)
    roles = [op.platoon_splits(events, role).withColumn("role", F.lit(role)) for role in ("batter", "pitcher")]
    return roles[0].unionByName(roles[1])


@query
def platoon_splits(spark, sf):
    """Left less right of every entity of both kinds; some met one side only."""
    return rounded(all_platoon_splits(spark, sf))


@query
def platoon_summary(spark, sf):
    """The matched difference over all batters."""
    return rounded(op.platoon_summary(op.platoon_splits(b.detailed_pitches(spark, sf))))


# Validation study


def paired(spark: SparkSession, sf: str) -> DataFrame:
    return op.block_pairs(appearances(spark, sf), b.pitches(spark, sf), b.STUDY, materialize=cut_lineage)


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    return plans.study_pairs(b.pitches(spark, sf), b.STUDY)


@query
def table_extent(spark, sf):
    return op.event_extent(b.pitches(spark, sf))


@query
def eligible_entities(spark, sf):
    return op.eligible_entities(b.pitches(spark, sf), "pitcher", 10)


@query
def half_aggregate(spark, sf):
    first_day = op.event_extent(b.pitches(spark, sf)).first()["first_day"]
    return rounded(op.half_aggregates(appearances(spark, sf), first_day, b.STUDY.windows))


@query
def block_pairs(spark, sf):
    return rounded(paired(spark, sf))


@query
def index_pairs(spark, sf):
    pairs = cut_lineage(op.paired_halves(appearances(spark, sf), b.pitches(spark, sf), b.STUDY))
    return op.index_pairs(pairs, b.STUDY.min_pairs).select("win", "half", "pid", "idx", "blk_idx", "n", "n_block")


@query
def predictive_stats(spark, sf):
    return rounded(op.predictive_stats(paired(spark, sf), ["win"]))


@query
def bootstrap_replicates(spark, sf):
    return rounded(op.bootstrap_replicates(numbered(spark, sf), b.STUDY.bootstrap, b.STUDY.seed))


@query
def bootstrap_ci(spark, sf):
    return rounded(op.bootstrap_ci(numbered(spark, sf), b.STUDY.bootstrap, b.STUDY.seed))


@query
def poisson_replicates(spark, sf):
    return rounded(op.poisson_replicates(paired(spark, sf), b.STUDY.bootstrap, b.STUDY.seed))


@query
def poisson_ci(spark, sf):
    return rounded(op.poisson_ci(paired(spark, sf), b.STUDY.bootstrap, b.STUDY.seed))


@query
def null_shuffle_rank(spark, sf):
    positions = resampling.shuffled_positions(numbered(spark, sf), 5, b.STUDY.seed)
    return positions.select("rep", "win", "half", "blk_idx", "pos")


@query
def permutation_replicates(spark, sf):
    return rounded(op.permutation_replicates(numbered(spark, sf), b.STUDY.permutations, b.STUDY.seed))


@query
def permutation_null(spark, sf):
    return rounded(op.permutation_null(numbered(spark, sf), b.STUDY.permutations, b.STUDY.seed))


@query
def validation_study(spark, sf):
    return rounded(plans.validation_study(b.pitches(spark, sf), b.STUDY))


@query
def validation_study_year(spark, sf):
    """Appearances of one calendar year, blocks anchored at the first day of all."""
    params = b.StudyParams(windows=b.SHORT_WINDOWS, min_pa=5, bootstrap=20, permutations=20)
    return rounded(plans.validation_study(b.pitches(spark, sf), params, year=b.STUDY_YEAR))


@query
def validation_study_pitcher(spark, sf):
    """The study of the other kind."""
    params = b.StudyParams(windows=b.STUDY.windows, min_pa=5, bootstrap=20, permutations=20)
    return rounded(plans.validation_study(b.pitches(spark, sf), params, role="pitcher"))


@query
def window_sweep_empty(spark, sf):
    """Windows longer than the data next to one that fits: the former have no pairs."""
    params = b.StudyParams(windows=(720, 2000, 3000), min_pa=20, bootstrap=10, permutations=10)
    sweep = plans.validation_study(b.pitches(spark, sf), params)
    return sweep.select("win", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("n", F.lit(0)).alias("n"),
                        (F.col("verdict") == "not enough paired blocks").alias("is_empty"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(op.top_n(all_signals(spark, sf), b.REPORT.top_n))
