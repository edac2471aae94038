"""Run registered queries against their SQL counterparts and report differences.

    python tools/compare.py [--sf DIR] [--cores N] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gapgauge import build_session  # noqa: E402
from gapgauge.catalog import ORACLES, QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return "NULL" if value is None else str(value)


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def oracle_rows(sf: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    result = con.execute(sql)
    types = {d[0]: str(d[1]) for d in result.description}
    return rows_of([d[0] for d in result.description], result.fetchall()), types


def compare(spark, sf: str, name: str) -> bool:
    started = time.time()
    df = QUERIES[name](spark, sf)
    columns, ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    if name not in ORACLES:
        print(f"{name:26} rows only {len(ours):8} rows {spent:6.1f}s", flush=True)
        return bool(ours)
    (expected_columns, expected), types = oracle_rows(sf, ORACLES[name])
    good = columns == expected_columns and ours == expected
    print(f"{name:26} {'ok' if good else 'DIFFERS':8} {len(ours):8} rows {spent:6.1f}s", flush=True)
    if columns != expected_columns:
        print("   columns", columns, expected_columns)
    elif not good:
        print("   rows", len(ours), len(expected), "types", types, df.dtypes)
        mine, theirs = set(ours), set(expected)
        for label, some in (("ours", mine - theirs), ("sql ", theirs - mine)):
            for row in sorted(some)[:3]:
                print("   ", label, dict(zip(columns, row)))
    return good


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--cores", default="8")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    conf = {"spark.sql.shuffle.partitions": args.cores, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false"}
    spark = build_session("compare", f"local[{args.cores}]", conf)
    spark.sparkContext.setLogLevel("ERROR")
    bad = []
    for name in args.names or QUERIES:
        try:
            good = compare(spark, args.sf, name)
        except Exception as error:  # noqa: BLE001 - go on with the other queries
            print(f"{name:26} FAILED {type(error).__name__}: {str(error)[:1500]}", flush=True)
            good = False
        if not good:
            bad.append(name)
    print(len(args.names or QUERIES), "queries,", "not equal:", bad or "none")


if __name__ == "__main__":
    main()
