"""Splits, Poisson replicates, empirical chances and the stream that drops repeats."""

from __future__ import annotations

import math
from collections import defaultdict
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapgauge import operators as op
from gapgauge import sources
from gapgauge.functions import unit_draw
from gapgauge.operators.resampling import POISSON_ONE, interval
from gapgauge.params import StudyParams
from gapgauge.plans import IngestPaths, validation_study
from gapgauge.streaming import dedup_stream, late_rows, unique_rows
from tests.conftest import optimized_of, plan_of

EVENT = (
    "batter bigint, pitcher bigint, woba_denom int, woba_value double, estimated_woba_using_speedangle double, "
    "balls int, strikes int, pitch_type string, stand string, p_throws string"
)
ROWS = [
    (1, 9, 1, 0.5, None, 0, 0, "FF", "L", "L"), (1, 9, 1, 1.0, 0.25, 0, 1, "FF", "L", "R"), (1, 8, 1, None, 0.75, 0, None, "SL", "L", "R"),
    (1, 8, 0, 2.0, 0.5, None, 1, "SL", "R", "L"), (1, 8, 1, 0.0, None, None, None, None, "R", "L"), (2, 8, 1, 1.5, None, 3, 2, "CH", "R", "R"),
    (2, 7, 0, 1.0, 1.0, 3, 2, "CH", "R", None), (None, 9, 1, 1.0, 1.0, 1, 1, "FF", "L", "L"), (3, None, 1, 0.25, None, 1, 1, "FF", "S", "S"),
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, EVENT)


def valued():
    for b, p, denom, w, x, balls, strikes, kind, stand, throws in ROWS:
        w = w or 0.0
        yield b, p, denom == 1, w, w if x is None else x, balls, strikes, kind, stand, throws


def test_count_states_with_totals(spark, events):
    groups = defaultdict(list)
    for b, _, done, w, x, balls, strikes, *_ in valued():
        if b is not None and done:
            for level, key in ((0, (balls, strikes)), (1, (balls, None)), (2, (None, strikes)), (3, (None, None))):
                groups[(b, level, *key)].append((w, x))
    found = op.count_state_splits(events).collect()
    got = {(r.pid, r.level, r.balls, r.strikes): (r.n, r.woba, r.est_woba, r.gap) for r in found}
    assert len(found) == len(got) and set(got) == set(groups)
    for key, values in groups.items():
        w, x = np.mean(values, axis=0)
        assert got[key] == pytest.approx((len(values), w, x, x - w))
    assert op.count_state_splits(events.drop("balls")).count() == 0
    assert op.count_state_splits(events.limit(0)).count() == 0
    assert plan_of(op.count_state_splits(events)).count("Expand") == 1


def test_pitch_type_mix_shrinks_in_two_steps(events):
    cells = defaultdict(list)
    for _, p, done, _, x, _, _, kind, *_ in valued():
        if p is not None and kind is not None:
            cells[p, kind].append((done, x))
    all_done = [x for rows in cells.values() for done, x in rows if done]
    kind_rate = sum(all_done) / len(all_done)
    found = {r.pid: r for r in op.pitch_type_mix(events).collect()}
    assert set(found) == {p for p, _ in cells}
    for pid, row in found.items():
        own = {kind: rows for (p, kind), rows in cells.items() if p == pid}
        n, done = sum(map(len, own.values())), [x for rows in own.values() for d, x in rows if d]
        rate = (sum(done) + kind_rate * 250) / (len(done) + 250)
        assert row.n == n and row.rate == pytest.approx(rate) and set(row.mix) == set(own)
        assert sum(t.share for t in row.mix.values()) == pytest.approx(1)
        for kind, rows in own.items():
            xs = [x for d, x in rows if d]
            assert row.mix[kind].rate == pytest.approx((sum(xs) + rate * 50) / (len(xs) + 50)) and row.mix[kind].n_pa == len(xs)
    unfinished = op.pitch_type_mix(events.withColumn("woba_denom", F.lit(0))).collect()
    assert unfinished and all(r.rate is None for r in unfinished)
    assert op.pitch_type_mix(events.drop("pitch_type")).count() == 0 and op.pitch_type_mix(events.limit(0)).count() == 0
    with pytest.raises(ValueError, match="role"):
        op.pitch_type_mix(events, "runner")


def test_platoon_difference_has_a_variance(events):
    sides = defaultdict(lambda: {"L": [], "R": []})
    for b, _, done, w, *_, throws in valued():
        if b is not None and done and throws in ("L", "R"):
            sides[b][throws].append(w)
    found = {r.pid: r for r in op.platoon_splits(events).collect()}
    assert set(found) == set(sides) == {1, 2}
    left, right = sides[1]["L"], sides[1]["R"]
    variance = np.var(left, ddof=1) / len(left) + np.var(right, ddof=1) / len(right)
    one = found[1]
    assert (one.n_left, one.n_right) == (2, 2)
    assert (one.difference, one.variance, one.z) == pytest.approx((np.mean(left) - np.mean(right), variance, (np.mean(left) - np.mean(right)) / variance**0.5))
    # One side only: a rate there, no difference.
    assert (found[2].right_rate, found[2].left_rate, found[2].difference, found[2].z) == (1.5, None, None, None)
    summary = op.platoon_summary(op.platoon_splits(events)).first()
    assert summary.n_entities == 1 and summary.difference == pytest.approx(one.difference) and summary.z == pytest.approx(one.z)
    assert op.platoon_splits(events.drop("p_throws")).count() == 0
    assert op.platoon_summary(op.platoon_splits(events.limit(0))).first().n_entities == 0


PAIR = "win int, half bigint, pid bigint, woba_1 double, xwoba_1 double, woba_2 double"


@pytest.fixture(scope="module")
def pairs(spark):
    draw = np.random.default_rng(8)
    skill = draw.normal(0.32, 0.03, 300)
    rows = [(30, int(i % 4), i, *(float(skill[i] + draw.normal(0, s)) for s in (0.04, 0.02, 0.03))) for i in range(300)]
    return spark.createDataFrame(rows, PAIR)


def test_poisson_numbers_have_their_distribution(spark):
    assert POISSON_ONE[0] == pytest.approx(math.exp(-1)) and 1 - POISSON_ONE[-1] < 2**-48
    draws = spark.range(40_000).select(unit_draw("id").alias("u"))
    times = sum((F.when(F.col("u") >= p, 1).otherwise(0) for p in POISSON_ONE), F.lit(0))
    row = draws.select(times.alias("k")).agg(F.avg("k"), F.var_samp("k"), F.avg((F.col("k") == 0).cast("int"))).first()
    assert tuple(row) == pytest.approx((1, 1, math.exp(-1)), abs=0.03)


def test_weighted_statistics_equal_those_of_repeated_rows(pairs):
    weighted = pairs.withColumn("times", F.col("pid") % 4)
    repeated = weighted.filter("times > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times"))))
    a, b = op.weighted_predictive_stats(weighted, ["win"], "times").first(), op.predictive_stats(repeated, ["win"]).first()
    assert a.asDict() == pytest.approx(b.asDict(), rel=1e-9)
    alone = op.weighted_predictive_stats(pairs.filter("pid = 5").withColumn("times", F.lit(1)), ["win"], "times").first()
    assert alone.n == 1 and alone.r_w is None


def test_poisson_interval_is_close_to_the_exact_one(spark, pairs):
    numbered = pairs.withColumns({"idx": F.col("pid"), "row": F.col("pid"), "win_start": F.lit(0), "n": F.lit(300)})
    exact, near = op.bootstrap_ci(numbered, 400, 3).first(), op.poisson_ci(pairs, 400, 3).first()
    assert near.n_boot == 400
    for name in ("dr_lo", "dr_hi", "bp_lo", "bp_hi"):
        assert near[name] == pytest.approx(exact[name], abs=0.05)
    assert op.poisson_ci(pairs, 400, 3).first() == near
    # What moves are sums of replicates, not rows of them.
    plan = plan_of(op.poisson_replicates(pairs, 400, 3))
    assert plan.count("Exchange hashpartitioning(win") <= 3 and "SortMergeJoin" not in plan


def test_poisson_numbers_are_drawn_once_per_pair_and_replicate(pairs):
    replicates = op.poisson_replicates(pairs, 40, 3)
    assert optimized_of(replicates).count("md5(") == 1
    # Rows that count zero times change nothing.
    u = unit_draw(F.lit(3), F.lit("poisson"), "win", "half", "pid", "rep")
    times = sum((F.when(F.col("u") >= p, 1).otherwise(0) for p in POISSON_ONE), F.lit(0))
    drawn = pairs.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("u", u).withColumn("k", times)
    repeated = drawn.filter("k > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("k"))))
    expected = {r.rep: r.asDict() for r in op.predictive_stats(repeated, ["win", "rep"]).collect()}
    found = {r.rep: r.asDict() for r in replicates.collect()}
    assert set(found) == set(expected) == set(range(40))
    for rep, row in found.items():
        assert row == pytest.approx(expected[rep], rel=1e-9)


def test_an_undefined_replicate_leaves_no_interval(spark):
    rows = [(30, 0.1, 0.2), (30, None, 0.3), (60, 0.1, 0.2), (60, 0.3, 0.4)]
    found = {r.win: r for r in interval(spark.createDataFrame(rows, "win int, dr double, b_partial double")).collect()}
    assert found[30].dr_lo is None and found[30].dr_hi is None and found[30].bp_lo == pytest.approx(0.2025)
    assert found[60].dr_lo == pytest.approx(0.105) and found[30].n_boot == 2


def test_chances_count_the_null(spark, pairs):
    numbered = pairs.withColumns(
        {"idx": F.col("pid"), "row": F.col("half") * 75 + F.floor(F.col("pid") / 4), "blk_start": F.col("half") * 75,
         "blk_idx": F.floor(F.col("pid") / 4), "n_block": F.lit(75), "win_start": F.lit(0), "n": F.lit(300)}
    )
    observed = op.predictive_stats(pairs, ["win"]).first().b_coupled
    slopes = [r.b_coupled for r in op.permutation_replicates(numbered, 60, 4).collect()]
    row = op.permutation_null(numbered, 60, 4).first()
    above, below = sum(s >= observed for s in slopes), sum(s <= observed for s in slopes)
    assert (row.n_perm, row.n_above, row.n_below) == (60, above, below)
    assert (row.p_above, row.p_below) == pytest.approx(((1 + above) / 61, (1 + below) / 61))
    assert row.p_both == pytest.approx(min(1, 2 * min(1 + above, 1 + below) / 61))


def test_study_with_poisson_weights(spark):
    from gapgauge import bindings as b
    from tests.conftest import SF_SMALL

    params = StudyParams(windows=(360,), min_pa=3, bootstrap=30, permutations=5, poisson=True)
    row = validation_study(b.pitches(spark, SF_SMALL), params, role="pitcher").first()
    assert row.n_boot == 30 and row.dr_lo < row.dr_hi and row.p_both is not None


LANDED = T.StructType([T.StructField(n, t) for n, t in (("game_pk", T.LongType()), ("at_bat_number", T.IntegerType()), ("pitch_number", T.IntegerType()), ("game_date", T.DateType()), ("ts", T.TimestampType()), ("a", T.StringType()))])


def land(spark, paths, day, rows):
    spark.createDataFrame(rows, LANDED).coalesce(1).write.mode("append").parquet(f"{paths.landing}/day={day}")


def test_repeated_rows_of_a_stream_are_stored_once(spark, tmp_path):
    paths = IngestPaths(f"{tmp_path}/landing", f"{tmp_path}/events", f"{tmp_path}/ledger")
    start = datetime(2026, 4, 1, 12)
    rows = [(i // 10, i % 10, 0, None if i == 7 else date(2026, 4, 1), None if i == 7 else start + timedelta(hours=i), f"r{i}") for i in range(40)]

    def run(delay="10 days"):
        query = dedup_stream(spark, paths, str(tmp_path / "state"), LANDED, event_time="ts", delay=delay, files_per_batch=1)
        query.awaitTermination()
        return sorted(r.a for r in sources.read_events(spark, paths.events).collect()), late_rows(query)

    land(spark, paths, "2026-04-01", rows[:25] + rows[5:9])
    land(spark, paths, "2026-04-02", rows[20:30])
    names = sorted(r[5] for r in rows)
    assert run() == (sorted(names_of(rows[:30])), 0)
    assert run() == (sorted(names_of(rows[:30])), 0)  # nothing new
    land(spark, paths, "2026-04-01", rows[::-1])
    assert run() == (names, 0)
    # A row from long before the newest one is late: counted, not stored twice or judged.
    land(spark, paths, "2026-06-01", [(99, 0, 0, date(2026, 6, 1), datetime(2026, 6, 1), "new")])
    run()
    land(spark, paths, "2026-06-02", [(99, 1, 0, date(2026, 4, 1), datetime(2026, 4, 1), "late"), (99, 2, 0, date(2026, 6, 1), datetime(2026, 6, 1), "next")])
    assert run() == (sorted([*names, "new", "next"]), 1)
    stored = sources.read_events(spark, paths.events, ingest_day=True)
    assert stored.filter("a = 'r7'").first().game_date == date(2026, 4, 1)


def names_of(rows):
    return [r[5] for r in rows]


def test_unique_rows_of_a_table(spark):
    rows = spark.createDataFrame([(1, 1, 1, "x")] * 5 + [(1, 1, None, "y"), (1, 1, None, "z")], "game_pk int, at_bat_number int, pitch_number int, a string")
    dated = rows.withColumns({"game_date": F.lit(date(2026, 4, 1)), "day": F.lit(date(2026, 4, 1))})
    assert unique_rows(dated).count() == 2 and unique_rows(dated).columns == dated.columns
