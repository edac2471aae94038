"""Appearances, ordinals and trailing means against plain-Python loops."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from gapgauge.operators import entity_ordinals, pa_level, rolling_means, rolling_trends, trend_points
from gapgauge.operators.ordinals import ordinals_by_entity, ordinals_by_game
from gapgauge.params import TrendParams
from gapgauge.schemas import EVENT_COLUMNS
from tests.conftest import plan_of

START = date(2026, 4, 1)


def event(batter, pitcher, day, game, number, est, value, denom=1, speed=None):
    return (batter, pitcher, START + timedelta(days=day), game, number, "x", est, value, denom, speed, None)


def make_events(sizes: dict[int, int], seed=1, days=40):
    rng = random.Random(seed)
    rows = []
    for pid, n in sizes.items():
        for i in range(n):
            day = i * days // n
            contact = rng.random() < 0.6
            rows.append(
                event(pid, 900 + i % 3, day, day * 10 + i % 2, i, rng.random() if contact else None,
                      rng.choice([None, 0.0, 0.5, 1.0]), 1, 60 + rng.random() * 50 if contact else None)
            )
        rows.append(event(pid, 900, 0, 0, n + 5, 0.9, 0.9, 0, 100.0))  # no completed appearance
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def sizes():
    # Around the warm-up and around the thinning steps.
    return {1: 15, 2: 16, 3: 17, 4: 74, 5: 75, 6: 76, 7: 134, 8: 135, 9: 136, 10: 400, 11: 7000}


@pytest.fixture(scope="module")
def events(spark, sizes):
    return spark.createDataFrame(make_events(sizes), EVENT_COLUMNS).cache()


def ordered(rows, pid):
    mine = [r for r in rows if r.batter == pid and r.woba_denom == 1]
    return sorted(mine, key=lambda r: (r.game_date, r.game_pk, r.at_bat_number))


def trailing(values, window, minimum):
    out = []
    for i in range(len(values)):
        seen = [v for v in values[max(0, i - window + 1) : i + 1] if v is not None]
        out.append(sum(seen) / len(seen) if len(seen) >= minimum else None)
    return out


def expected_series(rows, pid, params):
    mine = ordered(rows, pid)
    worth = [r.woba_value or 0.0 for r in mine]
    deserved = [r.estimated_woba_using_speedangle for r in mine]
    deserved = [w if d is None else d for d, w in zip(deserved, worth)]
    return (
        mine,
        trailing(deserved, params.window, params.warmup),
        trailing(worth, params.window, params.warmup),
        trailing([r.launch_speed for r in mine], params.window, 10),
    )


def test_pa_level_folds_non_contact_back_in(spark):
    rows = [
        event(1, 2, 0, 1, 1, 0.7, 0.9),
        event(1, 2, 0, 1, 2, None, 0.7),
        event(1, 2, 0, 1, 3, None, None),
        event(1, 2, 0, 1, 4, float("nan"), 0.3),
        event(1, 2, 0, 1, 5, 0.5, 0.5, denom=0),
        event(None, 2, 0, 1, 6, 0.5, 0.5),
    ]
    got = pa_level(spark.createDataFrame(rows, EVENT_COLUMNS)).orderBy("at_bat_number").collect()
    assert [(r.xwoba_pa, r.woba_pa, r.is_bip) for r in got] == [
        (0.7, 0.9, True), (0.7, 0.7, False), (0.0, 0.0, False), (0.3, 0.3, False),
    ]


def test_pa_level_filters(spark, events):
    assert pa_level(events, ids=[]).count() == 0
    assert {r.pid for r in pa_level(events, ids=[1, 4, 77]).select("pid").distinct().collect()} == {1, 4}
    assert {r.pid for r in pa_level(events, "pitcher").select("pid").distinct().collect()} == {900, 901, 902}
    recent = pa_level(events, days=5, as_of=START + timedelta(days=30))
    assert recent.agg({"game_date": "min"}).first()[0] == START + timedelta(days=25)
    assert pa_level(events, year=2025).count() == 0
    assert pa_level(events, year=2026).count() == pa_level(events).count()
    with pytest.raises(ValueError):
        pa_level(events, "umpire")


def test_filters_and_columns_reach_the_scan(spark, events, tmp_path):
    path = str(tmp_path / "events")
    events.withColumn("unused", events.batter).write.partitionBy("game_date").parquet(path)
    plan = plan_of(pa_level(spark.read.parquet(path), days=5, as_of=START + timedelta(days=30)).select("pid", "xwoba_pa"))
    assert "EqualTo(woba_denom,1)" in plan
    assert "PartitionFilters: [isnotnull(game_date" in plan and "unused" not in plan
    assert "Exchange" not in plan


def test_both_numberings_agree_with_the_event_order(spark, events, sizes):
    pa = pa_level(events)
    rows = events.collect()
    for numbered in (ordinals_by_entity(pa), ordinals_by_game(pa), entity_ordinals(pa, sort_rows=100)):
        got = {}
        for r in numbered.collect():
            got.setdefault(r.pid, {})[r.ordinal] = (r.game_date, r.game_pk, r.at_bat_number, r.n_rows)
        for pid, n in sizes.items():
            want = [(r.game_date, r.game_pk, r.at_bat_number, n) for r in ordered(rows, pid)]
            assert [got[pid][i] for i in range(n)] == want


def test_one_entity_with_everything_on_one_day(spark):
    rows = [event(1, 900 + i % 7, 3, i // 9, i % 9, None, i / 1000) for i in range(900)] + [event(2, 9, 3, 1, 1, None, 0.5)]
    random.Random(5).shuffle(rows)
    pa = pa_level(spark.createDataFrame(rows, EVENT_COLUMNS))
    numbered = entity_ordinals(pa, sort_rows=10).filter("pid = 1").orderBy("ordinal").collect()
    assert [r.woba_pa for r in numbered] == [i / 1000 for i in range(900)]
    params = TrendParams(window=20, days=None)
    whole, split = (rolling_means(pa, params, n, 64).orderBy("pid", "ordinal").collect() for n in (10**6, 10))
    assert whole == split


def test_rows_without_day_or_game_come_first(spark):
    rows = [event(1, 2, 1, 5, 1, None, 0.1), event(1, 2, 1, None, 1, None, 0.2)]
    rows.append((1, 2, None, 7, 1, "x", None, 0.3, 1, None, None))
    pa = pa_level(spark.createDataFrame(rows, EVENT_COLUMNS))
    for numbered in (ordinals_by_entity(pa), ordinals_by_game(pa)):
        assert [r.woba_pa for r in numbered.orderBy("ordinal").collect()] == [0.3, 0.2, 0.1]


@pytest.mark.parametrize("sort_rows,segment_rows", [(10**6, 10**5), (100, 60), (0, 50)])
def test_rolling_means(spark, events, sizes, sort_rows, segment_rows):
    params = TrendParams(window=50)
    rows = events.collect()
    got = {(r.pid, r.ordinal): r for r in rolling_means(pa_level(events), params, sort_rows, segment_rows).collect()}
    assert len(got) == sum(sizes.values())
    for pid in (1, 2, 7, 10):
        _, x, w, ev = expected_series(rows, pid, params)
        for i in range(len(x)):
            r = got[pid, i]
            for mine, theirs in ((r.x_roll, x[i]), (r.w_roll, w[i]), (r.ev_roll, ev[i])):
                assert mine == (None if theirs is None else pytest.approx(theirs, abs=1e-12))


@pytest.mark.parametrize("window", [15, 50, 90])
@pytest.mark.parametrize("sort_rows", [10**6, 100])
def test_trend_points(spark, events, sizes, window, sort_rows):
    params = TrendParams(window=window, days=None)
    rows = events.collect()
    got = {}
    for r in trend_points(pa_level(events), params, sort_rows).collect():
        got.setdefault(r.pid, {})[r.pa] = r
    for pid in sizes:
        mine, x, w, ev = expected_series(rows, pid, params)
        kept = [(r, a, b, c) for r, a, b, c in zip(mine, x, w, ev) if a is not None]
        n = len(kept)
        places = [i for i in range(n) if i % max(1, n // 60) == 0 or i == n - 1]
        assert sorted(got.get(pid, {})) == places
        for i in places:
            r, a, b, c = kept[i]
            point = got[pid][i]
            assert point.d == r.game_date
            assert point.x == pytest.approx(a, abs=5.1e-5) and point.w == pytest.approx(b, abs=5.1e-5)
            assert point.ev == (None if c is None else pytest.approx(c, abs=0.051))


def test_trends_are_ordered_bounded_arrays(spark, events):
    params = TrendParams(days=None)
    got = {r.pid: r.points for r in rolling_trends(events, [1, 2, 11], "batter", params).collect()}
    assert len(got[11]) <= 121 and got[11][-1].pa == 7000 - params.warmup
    assert [p.pa for p in got[11]] == sorted(p.pa for p in got[11])
    assert list(got[2][0].asDict()) == ["d", "pa", "x", "w", "ev"]


def test_thinning_discards_rows_before_the_last_shuffle(spark):
    rows = make_events({1: 20_000}, days=30)
    pa = pa_level(spark.createDataFrame(rows, EVENT_COLUMNS))
    got = trend_points(pa, TrendParams(window=15, days=None)).collect()
    assert len(got) <= 121 and max(r.appearance for r in got) == 20_000


def test_short_window_is_rejected():
    with pytest.raises(ValueError):
        TrendParams(window=10)
