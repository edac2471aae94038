"""Block pairs, statistics and replicates against numpy and plain loops."""

from __future__ import annotations

import hashlib
import random
import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapgauge import StudyParams, cut_lineage
from gapgauge.operators import (
    block_pairs,
    bootstrap_ci,
    bootstrap_replicates,
    eligible_entities,
    event_extent,
    half_aggregates,
    index_pairs,
    pa_level,
    permutation_null,
    permutation_replicates,
    predictive_stats,
)
from gapgauge.operators import resampling
from gapgauge.operators.statistics import verdict
from gapgauge.plans import study_pairs, validation_study
from gapgauge.schemas import EVENT_COLUMNS, INGEST_LOG
from gapgauge.sources import ledger_extent
from tests.conftest import plan_of

START = date(2025, 12, 1)
PARAMS = StudyParams(windows=(7, 20, 45, 400), min_pa=3, min_pairs=8, bootstrap=40, permutations=40)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for pid in range(40):
        skill = rng.gauss(0.3, 0.05)
        for i in range(rng.randrange(20, 120)):
            day = rng.randrange(0, 100)
            contact = rng.random() < 0.7
            est = max(0.0, rng.gauss(skill, 0.1)) if contact else None
            value = max(0.0, rng.gauss(skill, 0.3))
            out.append((pid * 1021 if pid % 4 else pid, 5, START + timedelta(days=day), day, i, "x", est, value,
                        1 if rng.random() < 0.9 else 0, None, None))
    return out


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, EVENT_COLUMNS).cache()


@pytest.fixture(scope="module")
def indexed(spark, events):
    return study_pairs(events, PARAMS)


def brute_pairs(rows, params):
    """(win, half, pid) -> rates of both periods, block by block over date ranges."""
    done = [r for r in rows if r[8] == 1]
    first, last = min(r[2] for r in rows), max(r[2] for r in rows)
    found = {}
    for win in params.windows:
        half = 0
        while first + timedelta(days=(half + 2) * win) <= last + timedelta(days=1):
            a = first + timedelta(days=half * win)
            periods = []
            for k in (0, 1):
                lo, hi = a + timedelta(days=k * win), a + timedelta(days=(k + 1) * win)
                by_pid = {}
                for r in done:
                    if lo <= r[2] < hi:
                        by_pid.setdefault(r[0], []).append((r[7], r[7] if r[6] is None else r[6]))
                periods.append(by_pid)
            block = {
                (win, half, pid): (a, *[(len(p[pid]), *np.mean(p[pid], axis=0)) for p in periods])
                for pid in periods[0]
                if pid in periods[1] and min(len(p[pid]) for p in periods) >= params.min_pa
            }
            if len(block) >= params.min_pairs:
                found |= block
            half += 1
    return found


def test_block_pairs_equal_the_date_ranges(spark, events, rows):
    want = brute_pairs(rows, PARAMS)
    got = {(r.win, r.half, r.pid): r for r in block_pairs(pa_level(events), events, PARAMS).collect()}
    assert set(got) == set(want) and {k[0] for k in want} == {7, 20, 45}
    for key, (start, one, two) in want.items():
        r = got[key]
        assert r.block_start == start
        assert (r.pa_1, r.pa_2) == (one[0], two[0])
        assert (r.woba_1, r.xwoba_1, r.woba_2, r.xwoba_2) == pytest.approx((*one[1:], *two[1:]))


def test_blocks_are_anchored_at_all_events(spark, events):
    """Limiting the appearances to one year leaves the block starts where they were."""
    pairs = block_pairs(pa_level(events, year=2026), events, PARAMS)
    assert pairs.count() > 0
    for r in pairs.select("win", "block_start").distinct().collect():
        assert (r.block_start - START).days % r.win == 0


def test_extent_and_eligible_entities(spark, events, rows):
    extent = event_extent(events).first()
    assert (extent.first_day, extent.last_day) == (min(r[2] for r in rows), max(r[2] for r in rows))
    assert extent.n_rows == len(rows)
    counts = {}
    for r in rows:
        counts[r[0]] = counts.get(r[0], 0) + (r[8] == 1)
    got = {r.pid: r.n_pa for r in eligible_entities(events, "batter", 20).collect()}
    assert got == {p: n for p, n in counts.items() if n >= 40}


def test_numbering_is_dense(indexed):
    rows = indexed.collect()
    assert sorted(r.row for r in rows) == list(range(len(rows)))
    for win in {r.win for r in rows}:
        mine = sorted((r for r in rows if r.win == win), key=lambda r: r.idx)
        assert [r.idx for r in mine] == list(range(len(mine))) and {r.n for r in mine} == {len(mine)}
        assert [(r.half, r.pid % 1021, r.pid) for r in mine] == sorted((r.half, r.pid % 1021, r.pid) for r in mine)
        for half in {r.half for r in mine}:
            block = [r for r in mine if r.half == half]
            assert sorted(r.blk_idx for r in block) == list(range(block[0].n_block))


def residuals(y, x):
    slope, level = np.polyfit(x, y, 1)
    return y - level - slope * x


def numpy_stats(w1, x1, w2):
    """The partial coefficient comes from what w1 leaves unexplained in x1 and w2."""
    left_x, left_y = residuals(x1, w1), residuals(w2, w1)
    partial = left_x @ left_y / (left_x @ left_x) * x1.std() / w2.std()
    r_w, r_x = np.corrcoef([w1, x1, w2])[2, :2]
    coupled = np.polyfit(x1 - w1, w2 - w1, 1)[0]
    return r_w, r_x, partial, coupled, np.linalg.norm(w1 - w2) / len(w1) ** 0.5, np.linalg.norm(x1 - w2) / len(w1) ** 0.5


def columns_of(rows):
    return tuple(np.array([r[c] for r in rows]) for c in ("woba_1", "xwoba_1", "woba_2"))


def test_statistics_equal_least_squares(indexed):
    rows = indexed.collect()
    for r in predictive_stats(indexed, ["win"]).collect():
        r_w, r_x, partial, coupled, rmse_w, rmse_x = numpy_stats(*columns_of([p for p in rows if p.win == r.win]))
        assert (r.r_w, r.r_x, r.dr) == pytest.approx((r_w, r_x, r_x - r_w))
        assert (r.b_partial, r.b_coupled) == pytest.approx((partial, coupled))
        assert (r.rmse_w, r.rmse_x) == pytest.approx((rmse_w, rmse_x))


@pytest.mark.parametrize(
    "name,points,partial",
    [
        ("constant w1", [(0.5, 0.1, 0.2), (0.5, 0.2, 0.3), (0.5, 0.4, 0.3), (0.5, 0.3, 0.7)], "r_x"),
        ("constant x1", [(0.1, 0.5, 0.2), (0.2, 0.5, 0.3), (0.4, 0.5, 0.3)], 0.0),
        ("constant w2", [(0.1, 0.2, 0.5), (0.2, 0.5, 0.5), (0.4, 0.1, 0.5)], 0.0),
        ("x1 equals w1", [(0.1, 0.1, 0.2), (0.2, 0.2, 0.3), (0.4, 0.4, 0.3), (0.3, 0.3, 0.7)], "half"),
        ("single pair", [(0.1, 0.2, 0.3)], None),
    ],
)
def test_degenerate_samples(spark, name, points, partial):
    df = spark.createDataFrame([(1, *p) for p in points], "k int, woba_1 double, xwoba_1 double, woba_2 double")
    r = predictive_stats(df, ["k"]).first()
    if partial == "r_x":
        assert r.r_w is None and r.b_partial == pytest.approx(r.r_x)
    elif partial == "half":
        assert r.b_partial == pytest.approx(r.r_x / 2) and r.b_coupled is None
    else:
        assert r.b_partial == partial


def unit(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:12], 16) / 2**48


def test_bootstrap_draws_n_pairs_with_replacement(indexed):
    rows = {(r.win, r.idx): r for r in indexed.collect()}
    seed = 11
    got = {(r.win, r.rep): r for r in bootstrap_replicates(indexed, 6, seed).collect()}
    for win in (7, 20, 45):
        n = sum(w == win for w, _ in rows)
        for rep in range(6):
            drawn = [rows[win, int(unit(seed, "boot", win, rep, i) * n)] for i in range(n)]
            r_w, r_x, partial, *_ = numpy_stats(*columns_of(drawn))
            r = got[win, rep]
            assert r.n == n
            assert (r.r_w, r.r_x, r.b_partial) == pytest.approx((r_w, r_x, partial))


def test_bootstrap_interval_interpolates(indexed):
    reps = bootstrap_replicates(indexed, 40, 5).collect()
    for r in bootstrap_ci(indexed, 40, 5).collect():
        drs = [x.dr for x in reps if x.win == r.win]
        assert (r.dr_lo, r.dr_hi) == pytest.approx(tuple(np.percentile(drs, [2.5, 97.5])))
        assert r.n_boot == 40


def test_replicates_without_variance_are_skipped(spark):
    # Two pairs: half of the replicates draw the same pair twice.
    pairs = [(9, 0, START, i, 5, 0.1 + i, 0.2 + i, 5, 0.3 - i, 0.1) for i in range(2)]
    names = "win int, half bigint, block_start date, pid bigint, pa_1 bigint, woba_1 double, xwoba_1 double, pa_2 bigint, woba_2 double, xwoba_2 double"
    numbered = cut_lineage(index_pairs(spark.createDataFrame(pairs, names)))
    kept = bootstrap_replicates(numbered, 60, 1).count()
    assert 0 < kept < 60


def test_permutation_keeps_every_block(spark, indexed):
    positions = resampling.shuffled_positions(indexed, 3, 7)
    for r in positions.groupBy("rep", "win", "half").agg(
        F.sort_array(F.collect_list("pos")).alias("places"), F.max("n_block").alias("m")
    ).collect():
        assert r.places == list(range(r.m))
    in_parts = resampling.shuffled_positions(indexed, 3, 7, sort_rows=5)
    keys = ["rep", "win", "row_id", "pos"]
    one, many = (
        {tuple(r) for r in p.withColumn("row_id", F.col("blk_start") + F.col("blk_idx")).select(*keys).collect()}
        for p in (positions, in_parts)
    )
    assert one == many


def test_permutation_slopes(indexed):
    rows = indexed.collect()
    seed = 13
    got = {(r.win, r.rep): r.b_coupled for r in permutation_replicates(indexed, 3, seed).collect()}
    split = {(r.win, r.rep): r.b_coupled for r in permutation_replicates(indexed, 3, seed, sort_rows=4).collect()}
    assert split == pytest.approx(got)
    for win in (7, 20, 45):
        for rep in range(3):
            w1, x1, w2 = [], [], []
            mine = [r for r in rows if r.win == win]
            for half in {r.half for r in mine}:
                block = sorted((r for r in mine if r.half == half), key=lambda r: r.blk_idx)
                shuffled = sorted(block, key=lambda r: (unit(seed, "perm", win, rep, r.idx), r.idx))
                w1 += [r.woba_1 for r in block]
                w2 += [r.woba_2 for r in block]
                x1 += [r.xwoba_1 for r in shuffled]
            w1, x1, w2 = map(np.array, (w1, x1, w2))
            assert got[win, rep] == pytest.approx(np.polyfit(x1 - w1, w2 - w1, 1)[0])
    null = {r.win: r for r in permutation_null(indexed, 3, seed).collect()}
    slopes = [got[7, rep] for rep in range(3)]
    assert null[7].null_mean == pytest.approx(np.mean(slopes))
    assert null[7].null_hi == pytest.approx(np.percentile(slopes, 97.5))


def test_large_samples_shuffle_instead_of_broadcast(indexed, monkeypatch):
    small = {(r.win, r.rep): r.dr for r in bootstrap_replicates(indexed, 3, 2).collect()}
    monkeypatch.setattr(resampling, "BROADCAST_PAIRS", 0)
    large = bootstrap_replicates(indexed, 3, 2)
    assert "ResolvedHint" not in plan_of(large)
    assert {(r.win, r.rep): r.dr for r in large.collect()} == pytest.approx(small)


@pytest.mark.parametrize(
    "lo,hi,blocks,text",
    [
        (None, None, 5, "inconclusive"),
        (0.01, 0.2, 5, "xwOBA wins"),
        (-0.2, -0.01, 3, "wOBA wins"),
        (-0.1, 0.1, 4, "no evidence"),
        (0.0, 0.1, 2, "no evidence (only 2 blk)"),
    ],
)
def test_verdict(spark, lo, hi, blocks, text):
    df = spark.createDataFrame([(lo, hi, blocks)], "lo double, hi double, b bigint")
    assert df.select(verdict(F.col("lo"), F.col("hi"), F.col("b"))).first()[0] == text


def test_study_has_a_row_for_every_window(events):
    got = {r.win: r for r in validation_study(events, PARAMS).collect()}
    assert set(got) == {7, 20, 45, 400}
    assert got[400].verdict == "not enough paired blocks" and got[400].n is None
    assert got[45].n_blocks == 1 and got[45].verdict.endswith("(only 1 blk)")
    assert got[7].n_boot == 40 and got[7].n_perm == 40


def test_known_extent_saves_the_scan(spark, events, rows):
    days = spark.createDataFrame(
        [("pitches", d, 1, None) for d in {r[2] for r in rows}] + [("pitches", START + timedelta(days=500), 0, None)],
        INGEST_LOG,
    )
    extent = ledger_extent(days)
    assert extent == (min(r[2] for r in rows), max(r[2] for r in rows))
    keys = ["win", "half", "pid"]
    given, found = (study_pairs(events, PARAMS, extent=e).select(*keys).collect() for e in (extent, None))
    assert set(given) == set(found)


def test_study_of_no_events(spark):
    got = validation_study(spark.createDataFrame([], EVENT_COLUMNS), PARAMS).collect()
    assert [r.verdict for r in got] == ["not enough paired blocks"] * 4


def test_pairing_has_no_self_join(events):
    plan = plan_of(block_pairs(pa_level(events), events, PARAMS))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SortMergeJoin" not in plan


@pytest.mark.parametrize("windows", [(4, 6), (5, 7), (3,)])
def test_halves_are_summed_in_spans_dealt_by_entity(spark, windows):
    first = date(2001, 1, 1)
    rows = [(i % 3, first + timedelta(days=(7 * i) % 41), float(i % 5), float(i % 7)) for i in range(200)]
    expected = {}
    for pid, day, w, x in rows:
        for win in windows:
            one = expected.setdefault((win, (day - first).days // win, pid), [0, 0.0, 0.0])
            one[0], one[1], one[2] = one[0] + 1, one[1] + w, one[2] + x
    halves = half_aggregates(spark.createDataFrame(rows, "pid bigint, game_date date, woba_pa double, xwoba_pa double"), first, windows, 10_000_000)
    found = {(r.win, r.half, r.pid): r for r in halves.collect()}
    assert set(found) == set(expected)
    for key, (n, w, x) in expected.items():
        assert (found[key].pa, found[key].woba, found[key].xwoba) == (n, pytest.approx(w / n), pytest.approx(x / n))
    # What is repeated per window length is already dealt, over tasks that follow the rows.
    plan = plan_of(halves)
    tasks = max(spark.sparkContext.defaultParallelism, 5 * len(windows))
    assert "hashpartitioning(win" not in plan
    assert re.search(rf"Exchange hashpartitioning\(pid#\d+L?, {tasks}\), REPARTITION_BY_NUM", plan)
