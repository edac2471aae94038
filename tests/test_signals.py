"""Signals against plain-Python arithmetic, and the properties of the method."""

from __future__ import annotations

import math
import random
import statistics
from datetime import date

import pytest
from pyspark.sql import functions as F

from gapgauge import SignalParams
from gapgauge.operators import bottom_n, build_signals, ranked_all, signal_checks, tie_averaged_percentiles, top_n
from gapgauge.operators import signals as sg
from gapgauge.schemas import BATTED_BALL, EXPECTED_STATS
from tests.conftest import plan_of

SNAP = date(2026, 8, 29)
FIELDS = EXPECTED_STATS.names


def row(kind, i, pa, woba, est, snap=SNAP, **over):
    base = dict(
        snapshot_date=snap, player_type=kind, player_id=i, player_name=f"{kind} {i}", year=2026, pa=pa, bip=pa // 2,
        ba=None if woba is None else woba * 0.8, est_ba=None if est is None else est * 0.8,
        slg=None if woba is None else woba * 1.4, est_slg=None if est is None else est * 1.4, woba=woba, est_woba=est,
    )
    base.update(over)
    return tuple(base[f] for f in FIELDS)


def board(spark, rows):
    return spark.createDataFrame(rows, EXPECTED_STATS)


def contact_board(spark, rows):
    """rows of (kind, id, speed, barrels, hard)"""
    full = [(SNAP, k, i, f"{k} {i}", 50, s, s, 10.0, 3, b, 1.0, h) for k, i, s, b, h in rows]
    return spark.createDataFrame(full, BATTED_BALL)


@pytest.fixture(scope="module")
def synthetic():
    """200 entities per kind with two planted extremes each, some below the gate.

    The spread of the rates and the planted extremes are fixed values.
    """
    rng = random.Random(7)
    rows = []
    for kind, start in (("batter", 10_000), ("pitcher", 20_000)):
        for i in range(200):
            est = min(max(rng.gauss(0.320, 0.035), 0.2), 0.48)
            woba = min(max(est - rng.gauss(0, 0.022), 0.15), 0.52)
            if i == 0:
                est, woba = 0.400, 0.290
            if i == 1:
                est, woba = 0.270, 0.380
            pa = rng.randrange(160, 600) if i % 10 else (400 if i < 2 else 60)
            rows.append(row(kind, start + i, pa, woba, est))
    return rows


def percentiles(values):
    """value -> rounded percentile with averaged ties."""
    n = len(values)
    return {v: round(100 * (sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2) / n) for v in set(values)}


def test_signals_follow_the_definitions(spark, synthetic):
    got = {(r.player_type, r.player_id): r for r in build_signals(board(spark, synthetic)).collect()}
    assert len(got) == 400
    for kind, k, sign in (("batter", 200, 1), ("pitcher", 250, -1)):
        rows = [dict(zip(FIELDS, r)) for r in synthetic if r[1] == kind]
        pool = [r for r in rows if r["pa"] >= 150]
        gaps = [r["est_woba"] - r["woba"] for r in pool]
        mean, sd = statistics.fmean(gaps), statistics.stdev(gaps)
        league = statistics.fmean(r["est_woba"] for r in pool)
        ranks = percentiles([r["woba"] for r in pool])
        for r in rows:
            g = got[kind, r["player_id"]]
            z = (r["est_woba"] - r["woba"] - mean) / sd
            assert g.luck_z == pytest.approx(z)
            assert g.outlook == pytest.approx(sign * z)
            assert g.proj_woba_ros == pytest.approx((r["est_woba"] * r["pa"] + league * k) / (r["pa"] + k))
            assert g.proj_vs_current == pytest.approx(g.proj_woba_ros - r["woba"])
            assert g.qualified == (r["pa"] >= 150)
            assert g.flagged == (r["pa"] >= 150 and abs(z) >= 1.5)
            assert g.direction == ("positive regression" if sign * z > 0 else "negative regression")
            assert g.pct_woba == (ranks[r["woba"]] if r["pa"] >= 150 else None)


def test_planted_extremes_and_sign_convention(spark, synthetic):
    got = {r.player_id: r for r in build_signals(board(spark, synthetic)).collect()}
    assert got[10_000].luck_z > 2.5 and got[10_001].luck_z < -2.5
    assert got[10_000].direction == "positive regression"
    assert got[20_000].direction == "negative regression"


def test_larger_samples_shrink_less(spark):
    rows = [row("batter", i, 400, 0.3, 0.30 + i / 1000) for i in range(10)]
    rows += [row("batter", 100, 160, 0.3, 0.42), row("batter", 101, 600, 0.3, 0.42)]
    got = {r.player_id: r.proj_woba_ros for r in build_signals(board(spark, rows)).collect()}
    assert got[101] > got[100]


def test_checks_pass_and_catch_a_violation(spark, synthetic):
    signals = build_signals(board(spark, synthetic))
    checks = signal_checks(signals).first()
    assert checks.n_rows == 400 and checks.n_kinds == 2 and checks.n_flagged > 0
    assert all(v == 0 for k, v in checks.asDict().items() if k.startswith("bad_"))
    broken = signals.withColumn("outlook", F.col("luck_z"))
    assert signal_checks(broken).first().bad_outlook_sign == 200


@pytest.mark.parametrize("qualified,uses_pool", [(5, False), (6, True)])
def test_small_pool_falls_back_to_all_rows(spark, qualified, uses_pool):
    rows = [row("batter", i, 200, 0.3, 0.30 + 0.01 * i) for i in range(qualified)]
    rows += [row("batter", 50 + i, 20, 0.3, 0.40) for i in range(4)]
    got = build_signals(board(spark, rows)).collect()
    pool = [r for r in rows if r[5] >= 150] if uses_pool else rows
    assert got[0].league_mean_est_woba == pytest.approx(statistics.fmean(r[12] for r in pool))
    ranked = [r for r in got if r.pct_woba is not None]
    assert len(ranked) == (qualified if uses_pool else 0)


def test_equal_gaps_have_no_z(spark):
    rows = [row("pitcher", i, 200, 0.25, 0.25) for i in range(8)]
    for r in build_signals(board(spark, rows)).collect():
        assert r.luck_z is None and r.outlook is None
        assert r.flagged is False and r.direction == "negative regression"


def test_incomplete_rows_and_unknown_kinds_vanish(spark):
    rows = [row("batter", i, 200, 0.3, 0.31 + i / 100) for i in range(7)]
    rows += [row("batter", 90, 200, None, 0.3), row("batter", 91, 200, 0.3, float("nan")), row("runner", 92, 200, 0.3, 0.3)]
    assert {r.player_id for r in build_signals(board(spark, rows)).collect()} == set(range(7))


def test_text_cells_are_coerced(spark):
    texts = [("0.31", True), (" 0.32 ", True), ("3e-1", True), ("abc", False), ("", False), ("1d", False), ("0.3f", False)]
    rows = [(SNAP, "batter", i, "x", 2026, 200, 90, 0.2, 0.2, 0.4, 0.4, "0.30", t) for i, (t, _) in enumerate(texts)]
    schema = ", ".join(f"{f.name} {'string' if f.name in ('woba', 'est_woba') else f.dataType.simpleString()}" for f in EXPECTED_STATS)
    got = {r.player_id for r in build_signals(spark.createDataFrame(rows, schema)).collect()}
    assert got == {i for i, (_, good) in enumerate(texts) if good}


def test_latest_snapshot_is_shared_by_all_kinds(spark):
    old = date(2026, 8, 1)
    rows = [row("batter", i, 200, 0.3, 0.3 + i / 100, snap=old) for i in range(7)]
    rows += [row("pitcher", i, 200, 0.3, 0.3 + i / 100) for i in range(7)]
    assert {r.player_type for r in build_signals(board(spark, rows)).collect()} == {"pitcher"}
    earlier = build_signals(board(spark, rows), snapshot=old).collect()
    assert {r.player_type for r in earlier} == {"batter"}


def test_contact_board_is_joined_and_ranked(spark, synthetic):
    rows = [("batter", 10_000 + i, 85.0 + i % 7, float(i % 5), 30.0 + i) for i in range(150)]
    got = {r.player_id: r for r in build_signals(board(spark, synthetic), contact_board(spark, rows)).collect()}
    eligible = [s for k, i, s, *_ in rows if got[i].qualified]
    ranks = percentiles(eligible)
    for k, i, speed, *_ in rows:
        assert got[i].avg_hit_speed == speed
        assert got[i].pct_ev == (ranks[speed] if got[i].qualified else None)
    assert got[10_199].avg_hit_speed is None and got[10_199].pct_ev is None
    assert got[20_000].pct_ev is None


def test_absent_and_empty_contact_boards_give_the_same_columns(spark, synthetic):
    absent = build_signals(board(spark, synthetic))
    empty = build_signals(board(spark, synthetic), contact_board(spark, []))
    assert set(absent.columns) == set(empty.columns)
    assert absent.filter("pct_ev is not null or attempts is not null").count() == 0
    assert empty.filter("pct_ev is not null or attempts is not null").count() == 0


def test_empty_board(spark):
    assert build_signals(board(spark, [])).count() == 0


@pytest.mark.parametrize("distinct", [200, 12])
def test_percentiles_of_distinct_and_tied_values(spark, distinct):
    rng = random.Random(distinct)
    values = [rng.choice([-1, 1]) * rng.randrange(distinct) / 7 for _ in range(600)] + [i * 1e6 + 0.25 for i in range(50)]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "kind string, id int, v double")
    got = tie_averaged_percentiles(df, "kind", ["id"], {"p": (F.col("v"), F.lit(True))}).collect()
    want = percentiles(values)
    assert [r.p for r in sorted(got, key=lambda r: r.id)] == [want[v] for v in values]


def test_percentiles_of_extreme_and_clustered_values(spark):
    """NaN takes no part; far values and a narrow cluster rank as in one sort."""
    values = [-(2.0**60), 2.0**60, 2.0**51 + 1, *(1 + i * 2.0**-50 for i in range(200)), *map(float, range(-20, 20))]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([*values, float("nan"), None])], "kind string, id int, v double")
    got = tie_averaged_percentiles(df, "kind", ["id"], {"p": (F.col("v"), F.lit(True))}).collect()
    want = percentiles(values)
    assert [r.p for r in sorted(got, key=lambda r: r.id)] == [want[v] for v in values]


def test_percentiles_with_one_value_on_a_third_of_the_rows(spark):
    values = [0.0] * 1000 + [i / 1000 for i in range(1, 2001)]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "kind string, id int, v double")
    got = tie_averaged_percentiles(df, "kind", ["id"], {"p": (F.col("v"), F.lit(True))})
    assert got.filter("id < 1000").select("p").distinct().collect()[0].p == round(100 * 500.5 / 3000)
    assert got.filter("id = 2999").first().p == 100


def test_no_raw_rows_are_windowed_by_kind(spark, synthetic):
    """Windows over a kind may only see counts, never one row per entity."""
    df = spark.createDataFrame([("g", 1, 0.5)], "kind string, id int, v double")
    plan = plan_of(tie_averaged_percentiles(df, "kind", ["id"], {"p": (F.col("v"), F.lit(True))}))
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("sum(" in w and "rank" not in w for w in windows)


def test_lists(spark, synthetic):
    signals = build_signals(board(spark, synthetic))
    best = [r for r in top_n(signals, 5).collect() if r.player_type == "batter"]
    want = sorted((r for r in signals.collect() if r.player_type == "batter" and r.qualified), key=lambda r: (-r.outlook, r.player_id))
    assert [r.player_id for r in sorted(best, key=lambda r: r.position)] == [r.player_id for r in want[:5]]
    worst = [r for r in bottom_n(signals, 5).collect() if r.player_type == "batter"]
    assert {r.player_id for r in worst} == {r.player_id for r in want[-5:]}
    ranked = [r.est_woba for r in ranked_all(signals).collect() if r.player_type == "batter"]
    assert ranked == sorted(ranked, reverse=True)
    assert "WindowGroupLimit" in plan_of(top_n(signals, 5))


def test_null_outlooks_only_fill_up_a_list(spark):
    rows = [("batter", i, True, None if i < 3 else float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "player_type string, player_id bigint, qualified boolean, outlook double")
    assert [r.player_id for r in top_n(df, 4).orderBy("position").collect()] == [5, 4, 3, 0]
    assert [r.player_id for r in bottom_n(df, 4).orderBy("position").collect()] == [3, 4, 5, 0]


def test_kind_constants(spark):
    params = SignalParams().with_min_pa(batter=10, pitcher=20)
    df = spark.createDataFrame([("batter",), ("pitcher",)], "player_type string")
    assert [r[0] for r in df.select(sg.by_kind(params, "min_pa")).collect()] == [10, 20]
    assert math.isclose(params.flag_z, 1.5)
