"""The report document: valid JSON in part-file order, whole lists, NULL for NaN."""

from __future__ import annotations

import glob
import json
import random
from datetime import date, datetime, timedelta, timezone

import pytest

from gapgauge.operators import build_signals
from gapgauge.params import ReportParams, SignalParams, TrendParams
from gapgauge.plans import Store, build_report, refresh, report, write_report
from gapgauge.schemas import EVENT_COLUMNS, EXPECTED_STATS
from gapgauge.sources import read_events
from tests.test_signals import board, contact_board, row

PARAMS = ReportParams(signals=SignalParams(), top_n=5, trend_n=2, trend=TrendParams(window=15, days=None))


@pytest.fixture(scope="module")
def signals(spark):
    rng = random.Random(2)
    rows = [
        row(kind, i, 200 if i % 5 else 100, rng.gauss(0.3, 0.02), rng.gauss(0.3, 0.02))
        for kind in ("batter", "pitcher")
        for i in range(1, 41)
    ]
    return build_signals(board(spark, rows), contact_board(spark, [("batter", 1, float("nan"), 1.0, 2.0)]))


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(4)
    rows = [
        (b, 1 + b % 40, date(2026, 5, 1) + timedelta(days=i), i, 1, "x", rng.random(), rng.random(), 1, None, None)
        for b in range(1, 41)
        for i in range(30)
    ]
    return spark.createDataFrame(rows, EVENT_COLUMNS)


def document(lines, path):
    write_report(lines, str(path))
    return json.loads("".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*"))))


def test_document(spark, signals, events, tmp_path):
    stamp = datetime(2026, 8, 29, tzinfo=timezone.utc)
    doc = document(build_report(signals, events, 2026, PARAMS, generated_at=stamp), tmp_path / "report")
    assert list(doc) == ["generated_at", "year", "method", "groups", "trends"]
    assert doc["generated_at"] == "2026-08-29T00:00:00+00:00" and doc["year"] == 2026
    assert doc["method"] == {"min_pa_batter": 150, "min_pa_pitcher": 150, "flag_z": 1.5, "k_batter": 200, "k_pitcher": 250}
    rows = [r for r in signals.collect() if r.qualified]
    for kind in ("batter", "pitcher"):
        mine = [r for r in rows if r.player_type == kind]
        group = doc["groups"][kind]
        assert group["n_qualified"] == len(mine) == 32
        assert group["league_mean_est_woba"] == pytest.approx(mine[0].league_mean_est_woba)
        best = sorted(mine, key=lambda r: -r.outlook)
        assert [e["player_id"] for e in group["breakout"]] == [r.player_id for r in best[:5]]
        assert [e["player_id"] for e in group["regression"]] == [r.player_id for r in best[::-1][:5]]
        everyone = sorted(mine, key=lambda r: -r.est_woba)
        assert [e["player_id"] for e in group["all"]] == [r.player_id for r in everyone]
        assert list(group["all"][0]) == report.REPORT_COLUMNS
        assert group["all"][0]["est_woba"] == everyone[0].est_woba
        listed = {e["player_id"] for e in group["breakout"][:2] + group["regression"][:2]}
        assert {int(k) for k in doc["trends"][kind]} <= listed
        assert all(p["ev"] is None for points in doc["trends"][kind].values() for p in points)
    assert len(doc["trends"]["batter"]) == 4
    first = next(e for e in doc["groups"]["batter"]["all"] if e["player_id"] == 1)
    assert first["avg_hit_speed"] is None and first["brl_percent"] == 1.0


def test_kind_without_qualified_rows_is_left_out(spark, events, tmp_path):
    rows = [row("pitcher", i, 200, 0.3, 0.3 + i / 100) for i in range(1, 9)] + [row("batter", 1, 10, 0.3, 0.3)]
    doc = document(build_report(build_signals(board(spark, rows)), events, 2026, PARAMS), tmp_path / "report")
    assert list(doc["groups"]) == ["pitcher"] and list(doc["trends"]) == ["pitcher"]


def test_without_events_there_are_no_trends(signals, tmp_path):
    doc = document(build_report(signals, None, 2026, PARAMS), tmp_path / "report")
    assert doc["trends"] == {}


def test_failing_trends_skip_only_their_kind(signals, events, tmp_path, monkeypatch):
    real = report.rolling_trends

    def failing(events, ids, role, *rest):
        if role == "batter":
            raise RuntimeError("no batters today")
        return real(events, ids, role, *rest)

    monkeypatch.setattr(report, "rolling_trends", failing)
    doc = document(build_report(signals, events, 2026, PARAMS), tmp_path / "report")
    assert list(doc["trends"]) == ["pitcher"] and list(doc["groups"]) == ["batter", "pitcher"]


def test_nothing_to_report(spark):
    empty = build_signals(spark.createDataFrame([], EXPECTED_STATS))
    with pytest.raises(ValueError):
        build_report(empty, None, 2026, PARAMS)


def test_signals_without_a_qualified_entity(spark, events, tmp_path):
    below = build_signals(board(spark, [row("batter", i, 10, 0.3, 0.3 + i / 100) for i in range(1, 9)]))
    doc = document(build_report(below, events, 2026, PARAMS), tmp_path / "report")
    assert doc["groups"] == {} and doc["trends"] == {} and doc["year"] == 2026


def test_refresh_from_sources_to_report(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    day = date(2026, 3, 27)
    rows = [(b, 1, day.isoformat(), g, 1, "x", 0.4, 0.3, 1, 100.0, 20, "new") for b in range(1, 11) for g in range(20)]
    names = (
        "batter int, pitcher int, game_date string, game_pk int, at_bat_number int, events string, "
        "estimated_woba_using_speedangle double, woba_value double, woba_denom int, launch_speed double, "
        "launch_angle int, extra string"
    )
    spark.createDataFrame(rows, names).write.parquet(f"{store.ingest.landing}/day={day}")

    def expected(kind):
        if kind == "pitcher":
            raise OSError("source is down")
        fields = "`last_name, first_name` string, player_id int, pa int, woba double, est_woba double"
        return spark.createDataFrame([(f"Doe, J{i}", i, 200, 0.3, 0.3 + i / 100) for i in range(1, 11)], fields)

    params = ReportParams(trend=TrendParams(window=15, days=10))
    options = dict(through=date(2026, 3, 28), as_of=date(2026, 3, 29), snapshot=date(2026, 3, 28))
    failed = refresh(spark, store, expected, lambda kind: None, 2026, params=params, **options)
    assert list(failed["expected_stats"]) == ["pitcher"]
    assert failed["pitches"] == {date(2026, 3, d): "not landed yet" for d in (26, 28)}
    assert set(failed["batted_ball"]) == {"batter", "pitcher"}
    doc = json.loads("".join(open(f).read() for f in sorted(glob.glob(store.at("report/part-*")))))
    assert list(doc["groups"]) == ["batter"]
    assert doc["groups"]["batter"]["all"][0]["player_name"] == "J10 Doe"
    assert len(doc["trends"]["batter"]) == 10
    assert doc["trends"]["batter"]["1"][-1] == {"d": "2026-03-27", "pa": 5, "x": 0.4, "w": 0.3, "ev": 100.0}
    events = read_events(spark, store.ingest.events)
    assert events.filter("extra = 'new'").count() == 200


def test_refresh_without_any_board(spark, tmp_path):
    with pytest.raises(ValueError):
        refresh(spark, Store(str(tmp_path)), lambda k: None, lambda k: None, 2026, skip_events=True)
