"""Boards, names, calendar, ledger, drifting columns, ingest and stream."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gapgauge import sources
from gapgauge.functions import display_name
from gapgauge.plans import IngestPaths, daily_ingest, ingest_days, snapshot_ingest
from gapgauge.schemas import BATTED_BALL, EXPECTED_STATS
from gapgauge.sources.calendar import season_range
from gapgauge.sources.events import read_registry, wider_type
from gapgauge.sources.ledger import latest_entries
from gapgauge.streaming import ingest_stream
from gapgauge.streaming.ingest import days_to_retry
from tests.conftest import plan_of

SNAP = date(2026, 8, 29)


@pytest.mark.parametrize(
    "schema,row,name",
    [
        ("`last_name, first_name` string", ("Doe, Jane",), "Jane Doe"),
        ("`last_name, first_name` string", ("a, b, c",), "c  b a"),
        ("`last_name, first_name` string", ("Solo",), "Solo"),
        ("first_name string, last_name string", (" Jane ", " Doe "), "Jane Doe"),
        ("last_name string", ("Doe",), "Doe"),
        ("other string", ("x",), "unknown"),
        ("`last_name, first_name` string", (None,), None),
    ],
)
def test_display_name(spark, schema, row, name):
    df = spark.createDataFrame([row], schema)
    assert df.select(display_name(df.columns)).first()[0] == name


def test_expected_board_maps_columns_and_minimum(spark):
    source = spark.createDataFrame(
        [(1, "Doe, Jane", 50, "0.3", float("nan")), (2, "Roe, Jim", 49, "0.4", 0.2), (3, "Poe, Al", 90, "n/a", 0.2)],
        "player_id int, `last_name, first_name` string, pa int, woba string, est_woba double",
    )
    board = sources.load_expected_board(source, "batter", SNAP, 2026)
    assert board.schema.names == EXPECTED_STATS.names
    assert [f.dataType for f in board.schema] == [f.dataType for f in EXPECTED_STATS]
    got = {r.player_id: r for r in board.collect()}
    assert set(got) == {1, 3}
    assert (got[1].player_name, got[1].woba, got[1].est_woba, got[1].ba) == ("Jane Doe", 0.3, None, None)
    assert got[3].woba is None and got[3].snapshot_date == SNAP and got[3].year == 2026


def test_contact_board_renames_the_angle(spark):
    source = spark.createDataFrame([(1, 30, 12.5), (2, 29, 1.0)], "player_id long, attempts long, avg_hit_angle double")
    board = sources.load_contact_board(source, "pitcher", SNAP)
    assert board.schema.names == BATTED_BALL.names
    rows = board.collect()
    assert [(r.player_id, r.avg_launch_angle, r.player_name, r.barrels) for r in rows] == [(1, 12.5, "unknown", None)]


def test_second_run_of_a_snapshot_replaces_the_first(spark, tmp_path):
    path = str(tmp_path / "boards")
    source = spark.createDataFrame([(i, 100, 0.3) for i in range(10)], "player_id long, pa long, woba double")
    for kind, snap, n in (("batter", SNAP, 10), ("pitcher", SNAP, 10), ("batter", date(2026, 8, 1), 10), ("batter", SNAP, 4)):
        sources.replace_snapshot(sources.load_expected_board(source.filter(F.col("player_id") < n), kind, snap, 2026), path)
    counts = sources.read_board(spark, path, EXPECTED_STATS).groupBy("snapshot_date", "player_type").count().collect()
    assert {(r.snapshot_date.isoformat(), r.player_type): r["count"] for r in counts} == {
        ("2026-08-29", "batter"): 4, ("2026-08-29", "pitcher"): 10, ("2026-08-01", "batter"): 10,
    }


def test_snapshot_read_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "boards")
    source = spark.createDataFrame([(1, 100, 0.3)], "player_id long, pa long, woba double")
    sources.replace_snapshot(sources.load_expected_board(source, "batter", SNAP, 2026), path)
    plan = plan_of(sources.read_board(spark, path, EXPECTED_STATS).filter(F.col("snapshot_date") == F.lit(SNAP)))
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan


def test_snapshot_ingest_isolates_a_failing_board(spark, tmp_path):
    path = str(tmp_path / "boards")

    def read(kind):
        if kind == "batter":
            raise OSError("source is down")
        return spark.createDataFrame([(1, 100, 0.3)], "player_id long, pa long, woba double")

    failed = snapshot_ingest(read, path, SNAP, 2026)
    assert list(failed) == ["batter"] and "source is down" in failed["batter"]
    assert sources.read_board(spark, path, EXPECTED_STATS).count() == 1
    empty = snapshot_ingest(lambda kind: None, path, SNAP, 2026)
    assert set(empty) == {"batter", "pitcher"}


@pytest.mark.parametrize(
    "year,through,days_back,first,last",
    [
        (2026, date(2026, 4, 2), None, date(2026, 3, 26), date(2026, 4, 2)),
        (2026, date(2026, 4, 2), 3, date(2026, 3, 31), date(2026, 4, 2)),
        (2026, date(2026, 4, 2), 300, date(2026, 3, 26), date(2026, 4, 2)),
        (2024, date(2026, 4, 2), None, date(2024, 3, 28), date(2024, 11, 5)),
        (2019, date(2019, 4, 2), None, date(2019, 3, 28), date(2019, 4, 2)),
        (2026, date(2026, 1, 2), None, None, None),
    ],
)
def test_calendar(spark, year, through, days_back, first, last):
    days = sorted(r.day for r in sources.season_calendar(spark, year, through, days_back).collect())
    if first is None:
        assert days == []
        return
    assert (days[0], days[-1], len(days)) == (first, last, (last - first).days + 1)
    assert season_range(year, through, days_back) == (first, last)


def test_pending_days(spark):
    calendar = sources.season_calendar(spark, 2026, date(2026, 4, 1))
    done = spark.createDataFrame([(date(2026, 3, 27),), (date(2026, 4, 1),)], "day date")
    days = [r.day.isoformat() for r in sources.pending_days(calendar, done).collect()]
    assert days == ["2026-03-26", "2026-03-28", "2026-03-29", "2026-03-30", "2026-03-31"]
    newest = [r.day.isoformat() for r in sources.pending_days(calendar, done, newest_first=True, limit_days=2).collect()]
    assert newest == ["2026-03-31", "2026-03-30"]


def test_ledger_keeps_the_last_entry(spark):
    rows = [("p", date(2026, 4, 1), 5, datetime(2026, 4, 2)), ("p", date(2026, 4, 1), 7, datetime(2026, 4, 3)),
            ("q", date(2026, 4, 1), -1, datetime(2026, 4, 3))]
    ledger = latest_entries(spark.createDataFrame(rows, "scope string, day date, rows bigint, fetched_at timestamp"))
    assert {(r.scope, r.rows) for r in ledger.collect()} == {("p", 7), ("q", -1)}
    assert sources.ingested_days(ledger, "p").count() == 1
    assert sources.ingested_days(ledger, "q").count() == 0


def test_type_widening_rule():
    assert wider_type("int", "bigint") == "bigint"
    assert wider_type("double", "bigint") == "double"
    assert wider_type("string", "int") == "string"
    assert wider_type("boolean", "int") == "string"
    assert wider_type("date", "date") == "date"


def test_columns_may_come_go_and_widen(spark, tmp_path):
    path = str(tmp_path / "events")
    batches = [
        ("game_date string, a int, note string", [("2026-04-01", 1, "x")]),
        ("game_date timestamp, a double, b array<int>", [(datetime(2026, 4, 2, 13), 2.5, [1, 2])]),
        ("game_date date, b string, c struct<k: int>", [(date(2026, 4, 3), "late", (7,))]),
        ("game_date date, a string", [(date(2026, 4, 4), "word")]),
        ("game_date date, a int", [(date(2026, 4, 5), 5)]),
    ]
    for schema, rows in batches:
        assert sources.append_days(spark.createDataFrame(rows, schema), path) == len(rows)
    table = sources.read_events(spark, path).orderBy("game_date")
    assert dict(table.dtypes) == {"a": "string", "b": "string", "c": "string", "note": "string", "game_date": "date"}
    got = [(r.game_date.day, r.a, r.b, r.c, r.note) for r in table.collect()]
    assert got == [
        (1, "1", None, None, "x"), (2, "2.5", "[1,2]", None, None), (3, None, "late", '{"k":7}', None),
        (4, "word", None, None, None), (5, "5", None, None, None),
    ]
    assert set(read_registry(spark, path)["a"].values()) == {"int", "double", "string"}
    plan = plan_of(sources.read_events(spark, path).filter(F.col("game_date") == F.lit(date(2026, 4, 3))).select("b"))
    assert "EqualTo(game_date,2026-04-03)" in plan and "ReadSchema: struct<b:string,game_date:date>" in plan


def test_undated_rows_of_two_batches_both_stay(spark, tmp_path):
    path = str(tmp_path / "events")
    for day, a in (("2026-04-01", 1), ("2026-04-02", 3)):
        sources.append_days(spark.createDataFrame([(day, a), (None, a + 1)], "game_date string, a int"), path)
    rows = {(r.a, str(r.game_date), str(r.ingest_day)) for r in sources.read_events(spark, path, ingest_day=True).collect()}
    assert rows == {
        (1, "2026-04-01", "2026-04-01"), (2, "None", "2026-04-01"), (3, "2026-04-02", "2026-04-02"), (4, "None", "2026-04-02"),
    }
    with pytest.raises(Exception, match="ingest_day"):
        sources.append_days(spark.createDataFrame([(None, 1)], "game_date string, a int"), path)


def land(spark, root, day, schema, rows, fmt="parquet"):
    writer = spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").format(fmt)
    (writer.option("header", "true") if fmt == "csv" else writer).save(f"{root}/landing/day={day}")


def paths_in(root):
    return IngestPaths(f"{root}/landing", f"{root}/events", f"{root}/ledger")


def ledger_of(spark, paths):
    return {r.day.isoformat(): r.rows for r in sources.read_ledger(spark, paths.ledger).collect()}


def test_daily_ingest_resumes_and_remembers_empty_days(spark, tmp_path):
    """Every row of a landed day is kept, whatever its own date."""
    paths = paths_in(tmp_path)
    land(spark, tmp_path, "2026-03-26", "game_date string, a int", [("2026-03-26", 1), ("2026-03-26", 2)])
    (tmp_path / "landing" / "day=2026-03-27").mkdir()
    land(spark, tmp_path, "2026-03-28", "game_date string, a int, b int", [(None, 3, 4), ("2026-03-20", 9, 9)])
    assert daily_ingest(spark, paths, 2026, date(2026, 3, 28), newest_first=True, limit_days=2) == {}
    assert ledger_of(spark, paths) == {"2026-03-28": 2, "2026-03-27": 0}
    assert daily_ingest(spark, paths, 2026, date(2026, 3, 28)) == {}
    assert ledger_of(spark, paths) == {"2026-03-26": 2, "2026-03-27": 0, "2026-03-28": 2}
    # Everything is in the ledger: a changed file is not read again.
    land(spark, tmp_path, "2026-03-26", "game_date string, a int", [("2026-03-26", 7)])
    assert daily_ingest(spark, paths, 2026, date(2026, 3, 28)) == {}
    rows = {(r.a, r.game_date.isoformat()) for r in sources.read_events(spark, paths.events).collect()}
    assert rows == {(1, "2026-03-26"), (2, "2026-03-26"), (3, "2026-03-28"), (9, "2026-03-20")}


def test_a_day_that_has_not_landed_stays_pending(spark, tmp_path):
    paths = paths_in(tmp_path)
    land(spark, tmp_path, "2026-03-26", "game_date string, a int", [("2026-03-26", 1)])
    assert list(daily_ingest(spark, paths, 2026, date(2026, 3, 27))) == [date(2026, 3, 27)]
    assert ledger_of(spark, paths) == {"2026-03-26": 1}
    land(spark, tmp_path, "2026-03-27/part=a", "game_date string, a int", [("2026-03-27", 2)])
    assert daily_ingest(spark, paths, 2026, date(2026, 3, 27)) == {}
    assert sorted(r.a for r in sources.read_events(spark, paths.events).collect()) == [1, 2]


def test_repeated_day_is_replaced(spark, tmp_path):
    """A run that died between rows and ledger is simply repeated."""
    paths = paths_in(tmp_path)
    land(spark, tmp_path, "2026-03-26", "game_date string, a int", [("2026-03-26", 1), ("2026-03-26", 2)])
    for _ in range(2):
        assert ingest_days(spark, paths, [date(2026, 3, 26)]) == {}
    assert sources.read_events(spark, paths.events).count() == 2
    assert ledger_of(spark, paths) == {"2026-03-26": 2}


def test_failing_day_does_not_stop_the_others(spark, tmp_path):
    paths = paths_in(tmp_path)
    for day in ("2026-03-26", "2026-03-28"):
        land(spark, tmp_path, day, "game_date string, a int", [(day, 1)])
    broken = tmp_path / "landing" / "day=2026-03-27"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"this is no parquet file")
    failed = daily_ingest(spark, paths, 2026, date(2026, 3, 28))
    assert [d.isoformat() for d in failed] == ["2026-03-27"]
    assert ledger_of(spark, paths) == {"2026-03-26": 1, "2026-03-28": 1}
    land(spark, tmp_path, "2026-03-27", "game_date string, a int", [("2026-03-27", 1)])
    assert daily_ingest(spark, paths, 2026, date(2026, 3, 28)) == {}
    assert ledger_of(spark, paths)["2026-03-27"] == 1


def test_days_with_clashing_types_and_an_empty_folder(spark, tmp_path):
    paths = paths_in(tmp_path)
    land(spark, tmp_path, "2026-03-26", "game_date string, a int", [("2026-03-26", 1)])
    land(spark, tmp_path, "2026-03-27", "game_date string, a string, b array<int>", [("2026-03-27", "x", [1])])
    (tmp_path / "landing" / "day=2026-03-28").mkdir()
    (tmp_path / "landing" / "day=2026-03-28" / "_SUCCESS").touch()
    assert daily_ingest(spark, paths, 2026, date(2026, 3, 28)) == {}
    rows = sources.read_events(spark, paths.events).orderBy("game_date").collect()
    assert [(r.a, r.b) for r in rows] == [("1", None), ("x", "[1]")]
    assert ledger_of(spark, paths) == {"2026-03-26": 1, "2026-03-27": 1, "2026-03-28": 0}


def test_files_of_one_day_may_have_different_columns(spark, tmp_path):
    paths = paths_in(tmp_path)
    land(spark, tmp_path, "2026-03-26", "game_date string, a int", [("2026-03-26", 1)])
    more = spark.createDataFrame([("2026-03-26", 2)], "game_date string, b int")
    more.write.mode("append").parquet(f"{paths.landing}/day=2026-03-26")
    assert daily_ingest(spark, paths, 2026, date(2026, 3, 26)) == {}
    assert {(r.a, r.b) for r in sources.read_events(spark, paths.events).collect()} == {(1, None), (None, 2)}


def test_csv_days_with_different_types(spark, tmp_path):
    paths = paths_in(tmp_path)
    land(spark, tmp_path, "2026-03-26", "game_date string, a int", [("2026-03-26", 1)], "csv")
    land(spark, tmp_path, "2026-03-27", "game_date string, a double", [("2026-03-27", 1.5)], "csv")
    assert daily_ingest(spark, paths, 2026, date(2026, 3, 27), fmt="csv") == {}
    assert sorted(r.a for r in sources.read_events(spark, paths.events).collect()) == [1.0, 1.5]


def test_stream_picks_up_new_and_late_files(spark, tmp_path):
    paths = paths_in(tmp_path)
    checkpoint = str(tmp_path / "stream")

    def run():
        ingest_stream(spark, paths, checkpoint).awaitTermination()
        return sorted(r.a for r in sources.read_events(spark, paths.events).collect())

    land(spark, tmp_path, "2026-03-26", "game_date string, a int", [("2026-03-26", 1)])
    assert run() == [1]
    land(spark, tmp_path, "2026-03-27", "game_date string, a int, b int", [("2026-03-27", 2, 2)])
    spark.createDataFrame([("2026-03-26", 3)], "game_date string, a int").write.mode("append").parquet(
        f"{paths.landing}/day=2026-03-26"
    )
    assert run() == [1, 2, 3]
    assert run() == [1, 2, 3]
    assert ledger_of(spark, paths) == {"2026-03-26": 2, "2026-03-27": 1}


def test_stream_goes_on_after_a_damaged_day(spark, tmp_path):
    """Compressed files count, too; the bad day is tried again when mended."""
    paths, checkpoint = paths_in(tmp_path), str(tmp_path / "stream")
    folder = tmp_path / "landing"
    for day, content in (("2026-03-26", b"no parquet"), ("2026-03-27", None)):
        (folder / f"day={day}").mkdir(parents=True)
        if content:
            (folder / f"day={day}" / "part-0.parquet").write_bytes(content)
        else:
            land(spark, tmp_path, f"{day}/part=a", "game_date string, a int", [(day, 2)])
    ingest_stream(spark, paths, checkpoint).awaitTermination()
    assert [r.a for r in sources.read_events(spark, paths.events).collect()] == [2]
    assert days_to_retry(spark, paths) == [date(2026, 3, 26)]
    land(spark, tmp_path, "2026-03-26", "game_date string, a int", [("2026-03-26", 1)])
    for _ in range(2):  # taken up as a retry and as new files
        ingest_stream(spark, paths, checkpoint).awaitTermination()
    assert sorted(r.a for r in sources.read_events(spark, paths.events).collect()) == [1, 2]
    assert days_to_retry(spark, paths) == []


def test_stream_takes_up_compressed_files(spark, tmp_path):
    paths = paths_in(tmp_path)
    source = spark.createDataFrame([("2026-03-26", 1)], "game_date string, a int").coalesce(1)
    source.write.option("header", "true").option("compression", "gzip").csv(f"{paths.landing}/day=2026-03-26")
    ingest_stream(spark, paths, str(tmp_path / "stream"), "csv").awaitTermination()
    assert [r.a for r in sources.read_events(spark, paths.events).collect()] == [1]


def test_board_minimum_skips_cells_that_are_no_numbers(spark):
    source = spark.createDataFrame([("Doe, A", 1, "200"), ("Roe, B", 2, "n/a"), ("Poe, C", 3, None)], "`last_name, first_name` string, player_id int, pa string")
    assert [r["player_id"] for r in sources.load_expected_board(source, "batter", SNAP, 2026).collect()] == [1]
