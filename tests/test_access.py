"""Row groups skipped by entity, snapshots per kind, one entity with a third of all rows."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapgauge import sources
from gapgauge.operators import build_signals, entity_ordinals, pa_level, rolling_means
from gapgauge.operators import ordinals
from gapgauge.operators.signals import at_snapshot, latest_of_each_kind
from gapgauge.params import SignalParams, TrendParams
from gapgauge.schemas import EXPECTED_STATS
from tests.conftest import optimized_of, plan_of

START = date(2026, 4, 1)
EVENTS = (
    "batter bigint, pitcher bigint, game_date date, game_pk bigint, at_bat_number int, events string, "
    "estimated_woba_using_speedangle double, woba_value double, woba_denom int, launch_speed double, launch_angle double"
)


def rows_read(spark, df) -> tuple[int, list]:
    """Rows that the scan of the event files gave, and the result."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        found = [leaves.apply(i) for i in range(leaves.size())]
        return sum(x.metrics().apply("numOutputRows").value() for x in found if "parquet" in x.nodeName()), rows
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_short_list_of_entities_skips_row_groups(spark, tmp_path):
    path, draw = str(tmp_path / "events"), np.random.default_rng(3)
    rows = []
    for day in range(12):
        # Ids of every day lie all over the range, so minimum and maximum say nothing.
        for batter in draw.choice(1_000_000, 60, replace=False):
            rows.append((int(batter), int(batter) % 7, START + timedelta(day), day, 1, "x", None, 0.5, 1, None, None))
    sources.append_days(spark.createDataFrame(rows, EVENTS), path)
    wanted = [r[0] for r in rows if r[3] in (2, 9)][::6][:20]
    events = sources.read_events(spark, path)
    read, found = rows_read(spark, pa_level(events, "batter", wanted))
    whole, same = rows_read(spark, pa_level(events, "batter", spark.createDataFrame([(i,) for i in wanted], "pid bigint")))
    assert whole == len(rows) and read <= 4 * 60
    assert sorted(r.pid for r in found) == sorted(r.pid for r in same) == sorted(r[0] for r in rows if r[0] in set(wanted))
    assert pa_level(events, "batter", []).count() == 0
    many = pa_level(events, "batter", range(1000))
    assert "LeftSemi" in optimized_of(many) and many.count() == sum(r[0] < 1000 for r in rows)


def board(spark, rows):
    full = [(s, k, i, f"{k} {i}", s.year, pa, pa // 2, 0.2, 0.2, 0.4, 0.4, 0.3 + i / 1000, 0.3) for s, k, i, pa in rows]
    return spark.createDataFrame(full, EXPECTED_STATS)


def test_each_kind_is_taken_at_its_own_last_snapshot(spark, tmp_path):
    early, late = date(2026, 4, 1), date(2026, 4, 8)
    rows = [(early, "batter", i, 200) for i in range(8)] + [(early, "pitcher", i, 200) for i in range(3)] + [(late, "pitcher", i, 300) for i in range(5)]
    path = str(tmp_path / "board")
    sources.replace_snapshot(board(spark, rows), path)
    stored = sources.read_board(spark, path, EXPECTED_STATS)
    assert {tuple(r) for r in latest_of_each_kind(stored).collect()} == {("batter", early), ("pitcher", late)}
    assert at_snapshot(stored).filter("player_type = 'batter'").count() == 0  # the default keeps to one date
    chosen = at_snapshot(stored, per_kind=True)
    assert {(r.player_type, r.snapshot_date, r["count"]) for r in chosen.groupBy("player_type", "snapshot_date").count().collect()} == {("batter", early, 8), ("pitcher", late, 5)}
    assert "PartitionFilters: [((" in plan_of(chosen)
    assert at_snapshot(stored, date(2026, 4, 7), per_kind=True).count() == 11
    assert at_snapshot(stored, date(2026, 3, 1), per_kind=True).count() == 0
    assert at_snapshot(stored.limit(0), per_kind=True).count() == 0
    assert build_signals(stored, None, SignalParams(), per_kind=True).groupBy("player_type").count().count() == 2


@pytest.fixture(scope="module")
def hot(spark):
    """Entity 0 has a third of the rows, many of them in one game."""
    draw = np.random.default_rng(4)
    rows = []
    for i in range(900):
        pid = 0 if i % 3 == 0 else 1 + i % 40
        day = START + timedelta(int(draw.integers(0, 9)))
        rows.append((pid, 7, day, int(draw.integers(0, 3)), i, "x", float(draw.random()), 0.5, 1, float(draw.random()), None))
    return pa_level(spark.createDataFrame(rows, EVENTS), "batter")


def test_large_entities_are_numbered_the_same(spark, hot, monkeypatch):
    params = TrendParams(window=20, days=None)

    def means(**sizes):
        rounded = [F.round(c, 12).alias(c) for c in ("x_roll", "ev_roll")]
        return {tuple(r) for r in rolling_means(hot, params, **sizes).select("pid", "ordinal", "n_rows", *rounded).collect()}

    whole = means()
    assert len(whole) == 900 and max(r[2] for r in whole) == 300
    for size in (30, 100):
        assert means(sort_rows=size, segment_rows=50) == whole
    # More ids than are sent to every task go through a shuffle.
    monkeypatch.setattr(ordinals, "BROADCAST_IDS", 0)
    numbered = entity_ordinals(hot, 100)
    assert "ResolvedHint" not in numbered._jdf.queryExecution().analyzed().toString()
    assert numbered.count() == 900 and numbered.select("pid", "ordinal").distinct().count() == 900


def test_ordinary_entities_cost_two_scans(spark, hot):
    numbered = entity_ordinals(hot, 1000)
    plan = plan_of(numbered)
    assert plan.count("Window [") <= 2 and plan.count("Exchange hashpartitioning(pid") == 1 and "Join" not in plan
    assert numbered.agg(F.max("n_rows")).first()[0] == 300
