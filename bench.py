"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   folder with the test tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_REPEAT   runs per query, the best one counts (default 2)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gapgauge import StudyParams, build_session  # noqa: E402
from gapgauge import bindings as b  # noqa: E402
from gapgauge.catalog import QUERIES  # noqa: E402
from gapgauge.plans import validation_study  # noqa: E402

HEADLINES = [
    "signals",
    "pct_rank_events",
    "breakout_top_n",
    "pa_level",
    "entity_ordinals",
    "rolling_mean_rows",
    "rolling_trends",
    "block_pairs",
    "predictive_stats",
    "bootstrap_ci",
    "permutation_null",
    "validation_study",
    "append_with_drift",
    "daily_ingest",
]


def full_study(spark, sf_dir):
    """The study with the full number of replicates: 1000 and 500 per window."""
    return validation_study(b.pitches(spark, sf_dir), StudyParams(windows=b.STUDY.windows, min_pa=b.STUDY.min_pa))


def timed(spark, query, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    conf = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    spark = build_session("bench", f"local[{cpus}]", conf)
    spark.sparkContext.setLogLevel("ERROR")
    queries = {name: QUERIES[name] for name in HEADLINES} | {"full_study": full_study}
    timed(spark, QUERIES["gaps"], sf_dir)  # start-up cost belongs to no query
    seconds = {name: round(min(timed(spark, q, sf_dir) for _ in range(repeat)), 3) for name, q in queries.items()}
    result = {
        "metric": "headline queries, total time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
