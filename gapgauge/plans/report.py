"""The report: bounded lists and trends, the full ranking, one JSON document.

The full ranking grows with the entities, so the document is never assembled
in one place. It is an ordered dataset of text lines; the part files, read in
order, are the document.
"""

from __future__ import annotations

import json
import logging
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapgauge.functions import null_if_nan
from gapgauge.operators.toplists import bottom_n, top_n, trend_entities
from gapgauge.operators.trends import rolling_trends
from gapgauge.params import ReportParams
from gapgauge.session import cut_lineage

log = logging.getLogger(__name__)

# Names and order of the published columns.
REPORT_COLUMNS = [
    "player_id", "player_name", "player_type", "pa", "bip", "ba", "est_ba", "slg", "est_slg", "woba", "est_woba",
    "luck_gap", "luck_z", "outlook", "proj_woba_ros", "proj_vs_current", "pct_est_woba", "pct_woba", "pct_ev",
    "pct_barrel", "pct_hardhit", "avg_hit_speed", "brl_percent", "ev95percent", "avg_launch_angle", "qualified",
    "flagged", "direction",
]

LINE = "section int, kind_no int, part int, sort_key double, sort_id bigint, line string"
ROW = "_row"
HEAD, GROUPS, TRENDS = 0, 1, 2
BREAKOUT, REGRESSION, ALL = 1, 3, 5  # even parts hold the text between the lists


def group_summary(signals: DataFrame) -> DataFrame:
    """Per kind with qualified entities: their number and the league mean."""
    return (
        signals.filter("qualified")
        .groupBy("player_type")
        .agg(F.count(F.lit(1)).alias("n_qualified"), F.max("league_mean_est_woba").alias("league_mean_est_woba"))
    )


def null_safe(df: DataFrame) -> DataFrame:
    """NaN as NULL in every floating column, for JSON."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: null_if_nan(c) for c in floats}) if floats else df


def report_rows(signals: DataFrame) -> DataFrame:
    """The published columns, those that are present."""
    return null_safe(signals.select([c for c in REPORT_COLUMNS if c in signals.columns]))


def json_record(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _kind_no(params: ReportParams) -> Column:
    numbered = [F.when(F.col("player_type") == p.kind, F.lit(i)) for i, p in enumerate(params.signals.kinds)]
    return F.coalesce(*numbered)


def _elements(df: DataFrame, params: ReportParams, part: int, sort_key: Column, first: Column) -> DataFrame:
    record = json_record([c for c in REPORT_COLUMNS if c in df.columns])
    comma = F.when(first, F.lit("")).otherwise(F.lit(","))
    return df.select(
        F.lit(GROUPS).alias("section"),
        _kind_no(params).alias("kind_no"),
        F.lit(part).alias("part"),
        sort_key.cast("double").alias("sort_key"),
        F.col("player_id").alias("sort_id"),
        F.concat(F.lit("        "), comma, record).alias("line"),
    )


def build_trends(signals: DataFrame, events: DataFrame, params: ReportParams, as_of: date | None) -> dict[str, DataFrame]:
    """Trends of the listed entities per kind; a kind that fails is left out."""
    picked = trend_entities(signals, params.trend_n)
    trends = {}
    for p in params.signals.kinds:
        # At most twice trend_n; as a list they are looked for in the files.
        ids = [r["player_id"] for r in picked.filter(F.col("player_type") == p.kind).select("player_id").collect()]
        try:
            trends[p.kind] = cut_lineage(rolling_trends(events, ids, p.kind, params.trend, as_of))
        except Exception as error:  # noqa: BLE001 - one kind must not stop the report
            log.warning("trends of %s skipped: %s: %s", p.kind, type(error).__name__, error)
    return trends


def build_report(
    signals: DataFrame,
    events: DataFrame | None,
    year: int,
    params: ReportParams = ReportParams(),
    as_of: date | None = None,
    generated_at: datetime | None = None,
) -> DataFrame:
    """Lines of the JSON document with the columns that put them in order."""
    spark = signals.sparkSession
    # A number for every written row, since an entity may be repeated.
    signals = cut_lineage(null_safe(signals).withColumn(ROW, F.monotonically_increasing_id()))
    summary = {r["player_type"]: r for r in group_summary(signals).collect()}  # at most one row per kind
    if not summary and signals.isEmpty():
        raise ValueError("no signals to report")

    fixed: list[tuple[int, int, int, float, int, str]] = []

    def put(section: int, kind_no: int, part: int, *lines: str) -> None:
        fixed.extend((section, kind_no, part, float(i), 0, text) for i, text in enumerate(lines))

    stamp = (generated_at or datetime.now(timezone.utc)).isoformat(timespec="seconds")
    batter, pitcher = params.signals.batter, params.signals.pitcher
    # Keys of the document.
    method = {
        "min_pa_batter": batter.min_pa,
        "min_pa_pitcher": pitcher.min_pa,
        "flag_z": params.signals.flag_z,
        "k_batter": batter.shrink_pa,
        "k_pitcher": pitcher.shrink_pa,
    }
    put(HEAD, 0, 0, "{", f'  "generated_at": {json.dumps(stamp)},', f'  "year": {year},',
        f'  "method": {json.dumps(method)},', '  "groups": {')
    kinds = [(i, p.kind) for i, p in enumerate(params.signals.kinds)]
    present = [(i, kind) for i, kind in kinds if kind in summary]
    for order, (i, kind) in enumerate(present):
        row = summary[kind]
        put(GROUPS, i, 0, f'    {"," if order else ""}{json.dumps(kind)}: {{', f'      "n_qualified": {row["n_qualified"]},',
            f'      "league_mean_est_woba": {json.dumps(row["league_mean_est_woba"])},', '      "breakout": [')
        put(GROUPS, i, 2, '      ],', '      "regression": [')
        put(GROUPS, i, 4, '      ],', '      "all": [')
        put(GROUPS, i, 6, '      ]', '    }')
    put(TRENDS, -1, 0, "  },", '  "trends": {')

    qualified = signals.filter("qualified")
    position = F.col("position")
    # The first entity of each full ranking, one row per kind.
    leaders = F.broadcast(
        qualified.groupBy("player_type").agg(F.min(F.struct(-F.col("est_woba"), "player_id", ROW)).alias("leader"))
    )
    ranked = qualified.join(leaders, "player_type")
    parts = [
        _elements(top_n(signals, params.top_n), params, BREAKOUT, position, position == 1),
        _elements(bottom_n(signals, params.top_n), params, REGRESSION, position, position == 1),
        _elements(ranked, params, ALL, -F.col("est_woba"), F.col(ROW) == F.col(f"leader.{ROW}")),
    ]
    trends = {} if events is None else build_trends(signals, events, params, as_of)
    for order, (i, kind) in enumerate([(i, k) for i, k in present if k in trends]):
        put(TRENDS, i, 0, f'    {"," if order else ""}{json.dumps(kind)}: {{')
        put(TRENDS, i, 2, "    }")
        first = trends[kind].agg(F.min("pid")).scalar()
        comma = F.when(F.col("pid") == first, F.lit("")).otherwise(F.lit(","))
        points = F.to_json("points", {"ignoreNullFields": "false"})
        parts.append(
            trends[kind].select(
                F.lit(TRENDS).alias("section"),
                F.lit(i).alias("kind_no"),
                F.lit(1).alias("part"),
                F.lit(0.0).alias("sort_key"),
                F.col("pid").alias("sort_id"),
                F.concat(F.lit("      "), comma, F.lit('"'), F.col("pid").cast("string"), F.lit('": '), points).alias("line"),
            )
        )
    put(TRENDS + 1, 0, 0, "  }", "}")
    lines = spark.createDataFrame(fixed, LINE)
    for part in parts:
        lines = lines.unionByName(part)
    return lines


def write_report(lines: DataFrame, path: str) -> None:
    """Text part files that hold the JSON document when read in order."""
    # Of lines in the same place the one without a comma comes first.
    ordered = lines.orderBy("section", "kind_no", "part", "sort_key", "sort_id", F.desc("line"))
    ordered.select("line").write.mode("overwrite").text(path)
