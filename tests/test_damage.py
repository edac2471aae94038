"""Malformed lines, repeated entities, columns that drift without loss."""

from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gapgauge import sources
from gapgauge.operators.signals import attach_contact, build_signals
from gapgauge.params import SignalParams
from gapgauge.plans import IngestPaths, build_report, daily_ingest, ingest_days, rejected_counts, write_report
from gapgauge.schemas import BATTED_BALL, EXPECTED_STATS
from gapgauge.sources.damaged import read_rejected
from gapgauge.sources.events import logical_types, read_registry
from gapgauge.sources.widening import common_type, physical_name
from tests.conftest import plan_of

D26, D27, D28 = (date(2026, 3, d) for d in (26, 27, 28))
HEAD = "game_date,batter,pitcher,note,speed"


def put(root, day, lines, name="a.csv"):
    folder = root / "landing" / f"day={day}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def paths_in(root):
    return IngestPaths(f"{root}/landing", f"{root}/events", f"{root}/ledger")


def ledger_of(spark, paths, scope):
    return {r.day: r.rows for r in sources.read_ledger(spark, paths.ledger).filter(F.col("scope") == scope).collect()}


GOOD = [f'2026-03-26,{i},{i + 100},"a, ""b"" {i}",{i}.5' for i in range(60)]


def test_malformed_lines_are_set_aside(spark, tmp_path):
    paths = paths_in(tmp_path)
    bad = ["2026-03-26,2,99,98", "2026-03-26,3", "2026-03-26,4,5,x,1.5,more", '2026-03-26,5,6,"a,b",n/a', "someday,7,8,x,1.5"]
    put(tmp_path, D26, [HEAD, *GOOD[:30], *bad[:3]])
    put(tmp_path, D26, [HEAD, *GOOD[30:], *bad[3:], "2026-03-26,,,,"], "b.csv")
    assert ingest_days(spark, paths, [D26], "csv") == {}
    table = sources.read_events(spark, paths.events)
    assert dict(table.dtypes) == {"batter": "bigint", "pitcher": "bigint", "note": "string", "speed": "double", "game_date": "date"}
    rows = {(r.batter, r.pitcher, r.note, r.speed) for r in table.collect()}
    # The writer of the test doubles quotes, Spark's reader keeps them as they are.
    assert len(rows) == 61 and (None, None, None, None) in rows and {r[:2] for r in rows} >= {(i, i + 100) for i in range(60)}
    found = {(r.file.rsplit("/", 1)[1], r.reason, r.field, r.record) for r in read_rejected(spark, paths.set_aside).collect()}
    assert found == {
        ("a.csv", "missing fields", None, bad[0]), ("a.csv", "missing fields", None, bad[1]), ("a.csv", "surplus fields", None, bad[2]),
        ("b.csv", "unreadable value", "speed", '2026-03-26,5,6,"a,b",n/a'), ("b.csv", "unreadable value", "game_date", bad[4]),
    }
    assert ledger_of(spark, paths, "pitches") == {D26: 61} and ledger_of(spark, paths, "pitches_rejected") == {D26: 5}
    assert {(r.reason, r.rows) for r in rejected_counts(spark, paths).filter("reason = 'missing fields'").collect()} == {("missing fields", 2)}
    # Mended and asked for again, nothing is left aside.
    put(tmp_path, D26, [HEAD, *GOOD[:30]])
    put(tmp_path, D26, [HEAD, *GOOD[30:]], "b.csv")
    assert ingest_days(spark, paths, [D26], "csv") == {}
    assert read_rejected(spark, paths.set_aside).count() == 0 and sources.read_events(spark, paths.events).count() == 60
    assert ledger_of(spark, paths, "pitches_rejected") == {D26: 0}


def test_a_day_of_mostly_malformed_lines_fails_alone(spark, tmp_path):
    paths = paths_in(tmp_path)
    put(tmp_path, D26, [HEAD, *GOOD])
    put(tmp_path, D27, [HEAD, *["no,line"] * 9, *GOOD[:3]])
    put(tmp_path, D28, [HEAD, *GOOD[:5]])
    put(tmp_path, D28, ["batter,game_date,pitcher,note,speed", "1,2026-03-28,2,x,1.5"], "b.csv")  # columns in another order
    failed = daily_ingest(spark, paths, 2026, D28, fmt="csv")
    assert set(failed) == {D27, D28} and "9 of 12 lines" in failed[D27]
    assert ledger_of(spark, paths, "pitches") == {D26: 60} and sources.read_events(spark, paths.events).count() == 60
    put(tmp_path, D27, [HEAD, *GOOD[:3]])
    assert set(daily_ingest(spark, paths, 2026, D28, fmt="csv")) == {D28}


def test_known_numbers_stay_numbers(spark, tmp_path):
    """A third of unreadable values would make a new column text, but not a known one."""
    paths = paths_in(tmp_path)
    put(tmp_path, D26, ["game_date,a", *[f"2026-03-26,{i}" for i in range(9)]])
    put(tmp_path, D27, ["game_date,a,new", *[f"2026-03-27,{i},{i}" for i in range(6)], *["2026-03-27,?,?"] * 3])
    put(tmp_path, D28, ["game_date,A", *["2026-03-28,word"] * 3])
    assert daily_ingest(spark, paths, 2026, D27, fmt="csv") == {}
    assert logical_types(spark, paths.events) == {"a": "bigint", "new": "string"}
    assert {(r.field, r.rows) for r in rejected_counts(spark, paths).collect()} == {("a", 3)}
    assert daily_ingest(spark, paths, 2026, D28, fmt="csv") == {}
    assert logical_types(spark, paths.events)["a"] == "string"
    assert sources.read_events(spark, paths.events).filter("a = 'word'").count() == 3


def test_an_empty_column_settles_no_type(spark, tmp_path):
    paths = paths_in(tmp_path)
    put(tmp_path, D26, ["game_date,a,b", "2026-03-26,,x"])
    put(tmp_path, D27, ["game_date,a,b", "2026-03-27,5,"])
    put(tmp_path, D28, ["game_date,a,b", ",,"])
    assert daily_ingest(spark, paths, 2026, D28, fmt="csv") == {}
    assert logical_types(spark, paths.events) == {"a": "bigint", "b": "string"}
    assert {(r.a, r.b, r.game_date) for r in sources.read_events(spark, paths.events).collect()} == {(None, "x", D26), (5, None, D27), (None, None, D28)}


def test_json_lines_that_are_no_objects(spark, tmp_path):
    paths = paths_in(tmp_path)
    put(tmp_path, D26, ['{"game_date": "2026-03-26", "a": 1, "b": [1, 2]}', '{"a": 2', "word", '{"a": 3}'], "a.json")
    put(tmp_path, D27, ['{"a": 5}'], "a.json")
    put(tmp_path, D28, ["[", "x", '{"a": 1}'], "a.json")
    assert set(daily_ingest(spark, paths, 2026, D28, fmt="json")) == {D28}
    assert {(r.a, r.b, r.game_date) for r in sources.read_events(spark, paths.events).collect()} == {(1, "[1,2]", D26), (3, None, D26), (5, None, D27)}
    assert {r.record for r in read_rejected(spark, paths.set_aside).collect()} == {'{"a": 2', "word"}
    assert ledger_of(spark, paths, "pitches_rejected") == {D26: 2, D27: 0}


def test_files_without_rows(spark, tmp_path):
    paths = paths_in(tmp_path)
    put(tmp_path, D26, [HEAD])
    (tmp_path / "landing" / f"day={D27}").mkdir()
    (tmp_path / "landing" / f"day={D27}" / "a.csv").touch()
    assert daily_ingest(spark, paths, 2026, D27, fmt="csv") == {}
    assert ledger_of(spark, paths, "pitches") == {D26: 0, D27: 0}


@pytest.mark.parametrize(
    "types,large,wanted",
    [
        (["int", "double"], False, "double"),
        (["bigint", "double"], False, "double"),
        (["bigint", "double"], True, "string"),
        (["int", "bigint"], True, "bigint"),
        (["decimal(10,2)", "decimal(12,3)"], False, "decimal(12,3)"),
        (["decimal(10,2)", "bigint"], False, "decimal(21,2)"),
        (["decimal(38,20)", "decimal(38,2)"], False, "string"),
        (["decimal(12,2)", "double"], False, "double"),
        (["decimal(20,2)", "double"], False, "string"),
        (["date", "timestamp"], False, "string"),
        (["boolean"], False, "boolean"),
    ],
)
def test_common_type(types, large, wanted):
    assert common_type(types, large) == wanted
    assert common_type(reversed(types), large) == wanted


def test_names_of_stored_columns():
    assert physical_name("a", "", {"b"}) == "a" and physical_name("a__double", "", {"A__double"}) == "a__double_"
    assert physical_name("a", "decimal(10,2)", set()) == "a__decimal_10_2"


def test_nothing_is_rounded_and_case_does_not_count(spark, tmp_path):
    path, big = str(tmp_path / "events"), (1 << 53) + 1
    batches = [
        ("game_date date, Big bigint, small int, m decimal(10,2), x__double int", [(D26, big, 1, Decimal("0.10"), 7)]),
        ("game_date date, big double, SMALL double, m decimal(20,4), X double", [(D27, 0.5, 2.5, Decimal("1234567890123456.7891"), 1.5)]),
        ("Game_Date date, BIG bigint, Small bigint, M bigint, x int", [(D28, -big, 3, 1 << 62, 2)]),
    ]
    for schema, rows in batches:
        assert sources.append_days(spark.createDataFrame(rows, schema), path) == 1
    table = sources.read_events(spark, path)
    assert {n.lower(): t for n, t in table.dtypes} == {
        "big": "string", "small": "double", "m": "decimal(23,4)", "x__double": "int", "x": "double", "game_date": "date",
    }
    got = [(r[0], r[1], r[2]) for r in table.orderBy("game_date").select("big", "small", "m").collect()]
    assert got == [
        (str(big), 1.0, Decimal("0.1000")), ("0.5", 2.5, Decimal("1234567890123456.7891")), (str(-big), 3.0, Decimal(1 << 62)),
    ]
    assert [tuple(r) for r in table.orderBy("game_date").select("x", "x__double").collect()] == [(None, 7), (1.5, None), (2.0, None)]
    physical = [p.lower() for columns in read_registry(spark, path).values() for p in columns]
    assert len(physical) == len(set(physical))
    assert "PushedFilters: [IsNotNull(game_date)" in plan_of(table.filter(F.col("game_date") == F.lit(D26)))


def test_a_batch_is_written_once_however_often_it_runs(spark, tmp_path):
    path = str(tmp_path / "events")
    for batch, a in ((0, 1), (1, 2), (1, 3)):
        sources.append_days(spark.createDataFrame([(D26, a)], "game_date date, a int"), path, batch)
    assert sorted(r.a for r in sources.read_events(spark, path).collect()) == [1, 3]


def test_stored_board_has_one_row_per_entity(spark, tmp_path):
    path = str(tmp_path / "board")
    source = spark.createDataFrame(
        [(1, 60, 0.3), (1, 80, 0.1), (1, 80, 0.2), (2, 70, 0.3), (None, 90, 0.3), (None, 95, 0.4)], "player_id long, pa long, woba double"
    )
    sources.replace_snapshot(sources.load_expected_board(source, "batter", D26, 2026), path)
    stored = sources.read_board(spark, path, EXPECTED_STATS)
    assert stored.columns == EXPECTED_STATS.names
    assert sorted((r.player_id or 0, r.pa, r.woba) for r in stored.collect()) == [(0, 90, 0.3), (0, 95, 0.4), (1, 80, 0.2), (2, 70, 0.3)]


def board_rows(spark, schema, ids, **values):
    fixed = {"snapshot_date": D26, "player_type": "batter", "player_name": "x", "year": 2026, **values}
    return spark.createDataFrame([tuple({**fixed, **row}.get(n) for n in schema.names) for row in ids], schema)


def test_contact_join_never_adds_rows(spark):
    signals = board_rows(spark, EXPECTED_STATS, [{"player_id": 1}, {"player_id": 2}, {"player_id": None}])
    contact = board_rows(spark, BATTED_BALL, [{"player_id": i, "attempts": n, "avg_hit_speed": float(n)} for i, n in ((1, 40), (1, 50), (1, 45), (None, 40))])
    rows = attach_contact(signals, contact).select("player_id", "attempts", "avg_hit_speed").collect()
    assert sorted((r[0] or 0, r[1], r[2]) for r in rows) == [(0, None, None), (1, 50, 50.0), (2, None, None)]


def test_report_of_repeated_entities_is_valid(spark, tmp_path):
    rates = [{"player_id": i // 2, "pa": 200, "woba": 0.3 + i // 2 / 100, "est_woba": 0.31, "ba": 0.2, "est_ba": 0.2, "slg": 0.4, "est_slg": 0.4} for i in range(16)]
    signals = build_signals(board_rows(spark, EXPECTED_STATS, rates), None, SignalParams())
    path = str(tmp_path / "report")
    write_report(build_report(signals, None, 2026, generated_at=datetime(2026, 4, 1)), path)
    document = json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
    assert document["groups"]["batter"]["n_qualified"] == len(document["groups"]["batter"]["all"]) >= 16
