"""SQL counterparts of the registered queries, written from the definitions.

They use the plain form of each operator (one window over a whole group,
explicit date ranges, self-joins), not the distributed form of the queries.
"""

from __future__ import annotations

from gapgauge import bindings as b

# The published columns, as the document has them.
REPORT_COLUMNS = (
    "player_id player_name player_type pa bip ba est_ba slg est_slg woba est_woba luck_gap luck_z outlook proj_woba_ros proj_vs_current "
    "pct_est_woba pct_woba pct_ev pct_barrel pct_hardhit avg_hit_speed brl_percent ev95percent avg_launch_angle qualified flagged direction"
).split()

ORACLES: dict[str, str] = {}


SHIFT = "3e-11"  # as in the queries: moves values off the half-way points of rounding


def rounding(expression: str, digits: int = 9) -> str:
    return f"round({expression} + {SHIFT}, {digits}) + 0.0"


def r9(*names: str, digits: int = 9) -> str:
    return ", ".join(f"{rounding(n, digits)} AS {n}" for n in names)


def decimal_even(expression: str, digits: int) -> str:
    """Half-even rounding of the decimal value, not of the binary one."""
    return f"CAST(round_even(CAST({expression} AS DECIMAL(18, 12)), {digits}) AS DOUBLE)"


PITCHES = """
pitches AS (
  SELECT l_suppkey AS batter, l_partkey AS pitcher, CAST(l_shipdate AS DATE) AS game_date,
    l_orderkey AS game_pk, l_linenumber AS at_bat_number, l_returnflag AS events,
    CASE WHEN l_returnflag <> 'R' THEN CAST(round(l_discount * 100) AS INTEGER) * 41 / 1024::DOUBLE END
      AS estimated_woba_using_speedangle,
    CASE WHEN l_quantity <= 48 THEN CAST(round(l_tax * 100) AS INTEGER) * 13 / 256::DOUBLE END AS woba_value,
    CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 0 ELSE 1 END AS woba_denom,
    CASE WHEN l_returnflag <> 'R' THEN l_quantity + 60 END AS launch_speed,
    CASE WHEN l_returnflag <> 'R' THEN l_linenumber * 5::DOUBLE END AS launch_angle
  FROM lineitem)"""

EXPECTED = f"""{PITCHES},
cuts AS (SELECT unnest([DATE '{b.EARLY}', DATE '{b.LATE}']) AS snapshot_date),
entity_rows AS (
  SELECT 'batter' AS player_type, batter AS player_id, * FROM pitches WHERE woba_denom = 1
  UNION ALL
  SELECT 'pitcher' AS player_type, pitcher AS player_id, * FROM pitches WHERE woba_denom = 1),
snapshot_rows AS (SELECT * FROM entity_rows JOIN cuts ON game_date <= snapshot_date),
measured AS (
  SELECT snapshot_date, player_type, player_id, count(*) AS pa,
    count(estimated_woba_using_speedangle) AS bip,
    avg(coalesce(woba_value, 0)) AS woba,
    avg(coalesce(estimated_woba_using_speedangle, woba_value, 0)) AS est_woba
  FROM snapshot_rows GROUP BY ALL),
expected_stats AS (
  SELECT snapshot_date, player_type, player_id, player_type || ' ' || player_id AS player_name,
    CAST(year(snapshot_date) AS INTEGER) AS year, pa, bip,
    woba * 0.8::DOUBLE AS ba, est_woba * 0.8::DOUBLE AS est_ba,
    woba * 1.4::DOUBLE AS slg, est_woba * 1.4::DOUBLE AS est_slg, woba, est_woba
  FROM measured)"""

CONTACT = f"""
contact_measured AS (
  SELECT snapshot_date, player_type, player_id, count(*) AS pa, count(launch_speed) AS attempts,
    avg(launch_speed) AS avg_hit_speed, max(launch_speed) AS max_hit_speed, avg(launch_angle) AS avg_launch_angle,
    count(CASE WHEN launch_speed >= 105 THEN 1 END) AS barrels,
    count(CASE WHEN launch_speed >= 95 THEN 1 END) AS hard
  FROM snapshot_rows GROUP BY ALL),
batted_ball AS (
  SELECT snapshot_date, player_type, player_id, attempts, avg_hit_speed, max_hit_speed, avg_launch_angle, barrels,
    100 * barrels / attempts::DOUBLE AS brl_percent, 100 * barrels / pa::DOUBLE AS brl_pa,
    100 * hard / attempts::DOUBLE AS ev95percent
  FROM contact_measured WHERE attempts >= {b.CONTACT_MINIMUM}),
contact AS (
  SELECT * FROM batted_ball WHERE snapshot_date = (SELECT max(snapshot_date) FROM batted_ball))"""

_min_pa = f"CASE player_type WHEN 'batter' THEN {b.SIGNALS.batter.min_pa} ELSE {b.SIGNALS.pitcher.min_pa} END"
_shrink = f"CASE player_type WHEN 'batter' THEN {b.SIGNALS.batter.shrink_pa} ELSE {b.SIGNALS.pitcher.shrink_pa} END"

GAPPED = f"""{EXPECTED},
gapped AS (
  SELECT *, est_woba - woba AS luck_gap, est_ba - ba AS ba_gap, est_slg - slg AS slg_gap,
    pa >= {_min_pa} AS qualified
  FROM expected_stats WHERE snapshot_date = (SELECT max(snapshot_date) FROM expected_stats))"""

CALIBRATED = f"""{GAPPED},
pools AS (
  SELECT player_type, count(*) FILTER (qualified) AS n_qualified,
    CASE WHEN count(*) FILTER (qualified) > 5 THEN avg(luck_gap) FILTER (qualified) ELSE avg(luck_gap) END AS gap_mean,
    CASE WHEN count(*) FILTER (qualified) > 5 THEN stddev_samp(luck_gap) FILTER (qualified)
      ELSE stddev_samp(luck_gap) END AS gap_sd,
    CASE WHEN count(*) FILTER (qualified) > 5 THEN avg(est_woba) FILTER (qualified)
      ELSE avg(est_woba) END AS league_mean_est_woba
  FROM gapped GROUP BY player_type),
zed AS (
  SELECT g.*, p.league_mean_est_woba,
    CASE WHEN gap_sd > 0 THEN (luck_gap - gap_mean) / gap_sd END AS luck_z
  FROM gapped g JOIN pools p USING (player_type)),
calibrated AS (
  SELECT *, CASE player_type WHEN 'batter' THEN luck_z ELSE -luck_z END AS outlook,
    (est_woba * pa + league_mean_est_woba * {_shrink}) / (pa + {_shrink}) AS proj_woba_ros,
    (est_woba * pa + league_mean_est_woba * {_shrink}) / (pa + {_shrink}) - woba AS proj_vs_current,
    coalesce(qualified AND abs(luck_z) >= 1.5, FALSE) AS flagged,
    CASE WHEN CASE player_type WHEN 'batter' THEN luck_z ELSE -luck_z END > 0
      THEN 'positive regression' ELSE 'negative regression' END AS direction
  FROM zed)"""


def percentile(value: str, by: str = "player_type", source: str = "ranked_source") -> str:
    """Average-tie percentile among rows that take part, at least six of them."""
    part = f"PARTITION BY {by}, {value} IS NOT NULL AND qualified"
    return f"""CASE WHEN qualified AND {value} IS NOT NULL AND count(*) OVER ({part}) > 5
      THEN round_even(100 * ((rank() OVER ({part} ORDER BY {value})
        + (count(*) OVER ({part}, {value}) - 1) / 2::DOUBLE) / count(*) OVER ({part})), 0) END"""


_contact_columns = "avg_hit_speed, brl_percent, ev95percent, avg_launch_angle, attempts"

SIGNALS = f"""{CALIBRATED},{CONTACT},
with_contact AS (
  SELECT c.*, {", ".join("k." + n.strip() for n in _contact_columns.split(","))}
  FROM calibrated c LEFT JOIN contact k USING (player_type, player_id)),
signals AS (
  SELECT *, {percentile("est_woba")} AS pct_est_woba, {percentile("woba")} AS pct_woba,
    {percentile("avg_hit_speed")} AS pct_ev, {percentile("brl_percent")} AS pct_barrel,
    {percentile("ev95percent")} AS pct_hardhit
  FROM with_contact)"""

_signal_doubles = [
    "ba", "est_ba", "slg", "est_slg", "woba", "est_woba", "luck_gap", "ba_gap", "slg_gap", "league_mean_est_woba",
    "luck_z", "outlook", "proj_woba_ros", "proj_vs_current", "avg_hit_speed", "brl_percent", "ev95percent",
    "avg_launch_angle", "pct_est_woba", "pct_woba", "pct_ev", "pct_barrel", "pct_hardhit",
]
_signal_others = [
    "snapshot_date", "player_type", "player_id", "player_name", "year", "pa", "bip", "qualified", "attempts",
    "flagged", "direction",
]


def pa_rows(role: str = "batter", extra: str = "") -> str:
    other = "pitcher" if role == "batter" else "batter"
    return f"""
pa_rows AS (
  SELECT {role} AS pid, {other} AS opponent, game_date, game_pk, at_bat_number, events,
    estimated_woba_using_speedangle AS xw_bip, coalesce(woba_value, 0) AS woba_value, woba_denom,
    launch_speed, launch_angle, coalesce(estimated_woba_using_speedangle, woba_value, 0) AS xwoba_pa,
    coalesce(woba_value, 0) AS woba_pa, estimated_woba_using_speedangle IS NOT NULL AS is_bip
  FROM pitches WHERE woba_denom = 1 {extra})"""


PA_COLUMNS = """pid, game_date, game_pk, at_bat_number, events, xw_bip, woba_value, woba_denom, launch_speed,
  launch_angle, xwoba_pa, woba_pa, is_bip"""

EVENT_ORDER = "game_date, game_pk, at_bat_number, opponent, woba_pa, xwoba_pa, launch_speed NULLS FIRST"

CALENDAR = f"""{PITCHES},
bounds AS (SELECT max(game_date) AS last_day FROM pitches),
calendar AS (
  SELECT CAST(unnest(generate_series(CAST(year(last_day) || '-03-28' AS DATE), last_day, INTERVAL 1 DAY)) AS DATE) AS day
  FROM bounds),
day_rows AS (SELECT game_date AS day, count(*) AS rows FROM pitches GROUP BY game_date),
full_days AS (SELECT * FROM day_rows WHERE rows >= (SELECT avg(rows) FROM day_rows))"""

DATED = "dated AS (SELECT *, CAST(ts AS DATE) AS game_date FROM events)"

# Sources and ingest

ORACLES["scan_events_day"] = f"""
WITH {DATED}
SELECT event_id, ts, user_id, event_type, {r9("value")}, props, game_date
FROM dated WHERE game_date = (SELECT max(game_date) FROM dated)"""


def board(kind: str) -> str:
    return f"""board_{kind} AS (
  SELECT {kind} AS player_id, count(*) AS pa, count(estimated_woba_using_speedangle) AS bip,
    avg(coalesce(woba_value, 0)) AS woba, avg(coalesce(estimated_woba_using_speedangle, woba_value, 0)) AS est_woba,
    count(launch_speed) AS attempts, avg(launch_speed) AS avg_hit_speed, max(launch_speed) AS max_hit_speed,
    avg(launch_angle) AS avg_launch_angle, count(CASE WHEN launch_speed >= 105 THEN 1 END) AS barrels
  FROM pitches WHERE woba_denom = 1 GROUP BY {kind})"""


BOARDS = f"{PITCHES}, {board('batter')}, {board('pitcher')}"
BOARD_NAMES = {"batter": "'Number ' || player_id || ' Supplier'", "pitcher": "'Number Part ' || player_id"}


def expected_board(kind: str, minimum: int) -> str:
    return f"""SELECT DATE '{b.LATE}' AS snapshot_date, '{kind}' AS player_type, player_id,
    {BOARD_NAMES[kind]} AS player_name, CAST({b.LATE.year} AS INTEGER) AS year, pa, bip,
    CAST(NULL AS DOUBLE) AS ba, CAST(NULL AS DOUBLE) AS est_ba, CAST(NULL AS DOUBLE) AS slg,
    CAST(NULL AS DOUBLE) AS est_slg, {r9("woba", "est_woba")}
  FROM board_{kind} WHERE pa >= {minimum}"""


def contact_board(kind: str, minimum: int) -> str:
    return f"""SELECT DATE '{b.LATE}' AS snapshot_date, '{kind}' AS player_type, player_id,
    {BOARD_NAMES[kind]} AS player_name, attempts, {r9("avg_hit_speed", "max_hit_speed", "avg_launch_angle")},
    barrels, CAST(NULL AS DOUBLE) AS brl_percent, CAST(NULL AS DOUBLE) AS brl_pa, CAST(NULL AS DOUBLE) AS ev95percent
  FROM board_{kind} WHERE attempts >= {minimum}"""


ORACLES["load_expected_board"] = f"""WITH {BOARDS}
{expected_board("batter", 50)} UNION ALL {expected_board("pitcher", b.SIGNALS.pitcher.min_pa)}"""
ORACLES["load_contact_board"] = f"""WITH {BOARDS}
{contact_board("batter", 30)} UNION ALL {contact_board("pitcher", b.CONTACT_MINIMUM)}"""
ORACLES["snapshot_ingest"] = f"""WITH {BOARDS}
{contact_board("batter", b.CONTACT_MINIMUM)} UNION ALL {contact_board("pitcher", b.CONTACT_MINIMUM)}"""



def repeated(rows: str) -> str:
    """Every entity twice, as the query makes it, of which the row with more attempts counts."""
    return f"""SELECT * FROM (
    SELECT * FROM {rows} UNION ALL
    SELECT * REPLACE (attempts + CASE WHEN player_id % 2 = 0 THEN 1 ELSE -1 END AS attempts, avg_hit_speed + 1 AS avg_hit_speed) FROM {rows})"""


def repeated_board(kind: str) -> str:
    return f"""SELECT '{kind}' AS player_type, player_id, attempts, {r9("avg_hit_speed")}, barrels
  FROM ({repeated(f"board_{kind}")}) WHERE attempts >= {b.CONTACT_MINIMUM}
  QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY attempts DESC) = 1"""


ORACLES["snapshot_ingest_repeated"] = f"""WITH {BOARDS}
{repeated_board("batter")} UNION ALL {repeated_board("pitcher")}"""
ORACLES["season_calendar"] = f"""WITH {CALENDAR}
SELECT day, coalesce(rows, 0) AS rows FROM calendar LEFT JOIN day_rows USING (day)"""
ORACLES["pending_days"] = f"""WITH {CALENDAR}
SELECT day FROM calendar WHERE day NOT IN (SELECT day FROM full_days)"""
ORACLES["pending_days_newest"] = f"""WITH {CALENDAR}
SELECT day FROM calendar WHERE day NOT IN (SELECT day FROM full_days) ORDER BY day DESC LIMIT 10"""
ORACLES["empty_day_marking"] = f"""WITH {CALENDAR}
SELECT 'pitches' AS scope, day, coalesce(rows, 0) AS rows FROM calendar LEFT JOIN full_days USING (day)"""

ORACLES["normalize_event_date"] = "SELECT event_id, CAST(ts AS DATE) AS game_date FROM events"
ORACLES["stringify_exotic"] = """
SELECT event_id, CAST(to_json([user_id, event_id]) AS VARCHAR) AS pair,
  CAST(to_json({'user_id': user_id, 'event_type': event_type}) AS VARCHAR) AS origin, event_type FROM events"""
ORACLES["append_with_drift"] = f"""
WITH {DATED}
SELECT event_id, ts, user_id, event_type,
  CASE WHEN game_date <= DATE '2024-01-15' THEN floor(value) ELSE {rounding("value")} END AS value,
  CASE WHEN game_date > DATE '2024-01-15' THEN props END AS props,
  CASE WHEN game_date > DATE '2024-01-15' THEN user_id + 1 END AS extra, game_date
FROM dated"""
ORACLES["append_lossless"] = f"""
WITH {DATED}
SELECT event_id, ts, props, game_date,
  CASE WHEN day(game_date) BETWEEN 11 AND 20 THEN CAST(value AS VARCHAR) ELSE CAST(event_id + 9007199254740993 AS VARCHAR) END AS big,
  CAST(CASE WHEN day(game_date) <= 10 THEN CAST(CAST(value AS DECIMAL(10, 2)) AS DECIMAL(22, 3))
    WHEN day(game_date) <= 20 THEN CAST(value AS DECIMAL(22, 3)) ELSE CAST(user_id AS DECIMAL(22, 3)) END AS VARCHAR) AS money,
  {rounding("CASE WHEN day(game_date) <= 20 THEN CAST(user_id AS DOUBLE) ELSE value END")} AS whole,
  CASE WHEN day(game_date) <= 10 THEN user_id WHEN day(game_date) <= 20 THEN user_id + 1 END AS extra
FROM dated"""
ORACLES["ledger_upsert"] = f"""
WITH {DATED},
entries AS (
  SELECT event_type AS scope, game_date AS day, count(*) AS rows, max(ts) AS fetched_at
  FROM dated GROUP BY event_type, game_date, hour(ts))
SELECT scope, day, rows, fetched_at FROM entries
QUALIFY row_number() OVER (PARTITION BY scope, day ORDER BY fetched_at DESC) = 1"""
ORACLES["daily_ingest"] = f"""
WITH {DATED},
calendar AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY)) AS DATE) AS day),
stored AS (
  SELECT game_date AS day, count(*) AS rows, sum(value) AS value, count(DISTINCT user_id) AS users
  FROM dated GROUP BY game_date)
SELECT 'pitches' AS scope, day, coalesce(rows, 0) AS rows, {r9("value", digits=6)}, users
FROM calendar LEFT JOIN stored USING (day)"""
ORACLES["stream_dedup"] = f"""
WITH {DATED} SELECT event_id, ts, user_id, event_type, {r9("value")}, props, game_date FROM dated"""
ORACLES["daily_ingest_damaged"] = f"""
WITH {DATED},
aside AS (
  SELECT game_date, CASE event_id % 3 WHEN 0 THEN 'missing fields' WHEN 1 THEN 'surplus fields' ELSE 'unreadable value' END AS reason,
    CASE WHEN event_id % 3 = 2 THEN 'user_id' END AS field
  FROM dated WHERE event_id % 50 = 0)
SELECT event_id, ts, user_id, event_type, {r9("value")}, props, game_date,
  CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS BIGINT) AS rows
FROM dated WHERE event_id % 50 <> 0
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, NULL, game_date, reason, field, count(*) AS rows FROM aside GROUP BY game_date, reason, field"""
ORACLES["daily_ingest_misdated"] = f"""
WITH {DATED} SELECT event_id, ts, user_id, event_type, {r9("value")}, props, game_date AS landed_on,
  CAST(game_date + CAST(event_id % 10 = 0 AS INTEGER) AS DATE) AS game_date FROM dated"""
ORACLES["late_landing"] = f"""
WITH {DATED} SELECT way, event_id, event_type, game_date FROM dated, (VALUES ('batch'), ('stream')) AS ways(way)"""
ORACLES["stream_ingest"] = f"""
WITH {DATED} SELECT event_id, ts, user_id, event_type, {r9("value")}, props, game_date FROM dated"""

_board_columns = (
    "snapshot_date, player_type, player_id, player_name, year, {pa}, bip, "
    + r9("ba", "est_ba", "slg", "est_slg", "woba", "est_woba")
)
ORACLES["replace_snapshot"] = f"""WITH {EXPECTED}
SELECT {_board_columns.format(pa="CASE WHEN player_type = 'batter' THEN pa ELSE 0 END AS pa")} FROM expected_stats"""
ORACLES["display_name"] = """
SELECT c_custkey, 'combined' AS layout, c_name || ' ' || c_mktsegment AS player_name FROM customer
UNION ALL BY NAME SELECT c_custkey, 'separate' AS layout, c_mktsegment || ' ' || c_name AS player_name FROM customer
UNION ALL BY NAME SELECT c_custkey, 'last_only' AS layout, c_name AS player_name FROM customer
UNION ALL BY NAME SELECT c_custkey, 'none' AS layout, 'unknown' AS player_name FROM customer"""
ORACLES["latest_snapshot"] = f"WITH {EXPECTED} SELECT max(snapshot_date) AS snapshot_date FROM expected_stats"
ORACLES["snapshot_per_kind"] = f"""WITH {EXPECTED},
gapped AS (
  SELECT *, est_woba - woba AS luck_gap, pa >= {_min_pa} AS qualified FROM expected_stats
  WHERE snapshot_date = CASE player_type WHEN 'batter' THEN DATE '{b.EARLY}' ELSE DATE '{b.LATE}' END),
pools AS (
  SELECT player_type, avg(luck_gap) FILTER (count_qualified <= 5 OR qualified) AS mu, stddev_samp(luck_gap) FILTER (count_qualified <= 5 OR qualified) AS sd
  FROM (SELECT *, count(*) FILTER (qualified) OVER (PARTITION BY player_type) AS count_qualified FROM gapped) GROUP BY player_type),
judged AS (SELECT g.*, CASE WHEN sd > 0 THEN (luck_gap - mu) / sd END AS luck_z FROM gapped g JOIN pools USING (player_type))
SELECT snapshot_date, player_type, player_id, pa, {r9("luck_gap", "luck_z")}, coalesce(qualified AND abs(luck_z) >= 1.5, FALSE) AS flagged,
  {rounding(percentile("woba"))} AS pct_woba FROM judged"""
ORACLES["scan_snapshot"] = f"""WITH {EXPECTED}
SELECT {_board_columns.format(pa="pa")} FROM expected_stats WHERE snapshot_date = DATE '{b.EARLY}'"""
ORACLES["null_safe_json"] = f"""WITH {GAPPED},{CONTACT}
SELECT player_type, player_id, CAST(to_json({{'player_id': player_id, 'player_name': player_name, 'attempts': attempts}})
  AS VARCHAR) AS record
FROM gapped LEFT JOIN contact USING (player_type, player_id)"""

# Projections and filters

ORACLES["numeric_coerce"] = """
WITH texts AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE l_returnflag WHEN 'N' THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
      WHEN 'A' THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || lower(l_linestatus)
      ELSE ' ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' ' END AS text
  FROM lineitem)
SELECT *, TRY_CAST(trim(text) AS DOUBLE) AS number FROM texts"""
ORACLES["drop_incomplete"] = f"""WITH {PITCHES},
board AS (
  SELECT CASE events WHEN 'A' THEN 'batter' WHEN 'N' THEN 'pitcher' ELSE 'runner' END AS player_type,
    batter AS player_id, game_date, count(*) AS pa, avg(woba_value) AS woba,
    avg(estimated_woba_using_speedangle) AS est_woba
  FROM pitches GROUP BY ALL)
SELECT player_type, player_id, game_date, pa, {r9("woba", "est_woba")}, {rounding("est_woba - woba")} AS luck_gap
FROM board WHERE player_type IN ('batter', 'pitcher') AND woba IS NOT NULL AND est_woba IS NOT NULL"""
ORACLES["gaps"] = f"""WITH {GAPPED}
SELECT player_type, player_id, {r9("luck_gap", "ba_gap", "slg_gap")}, qualified FROM gapped"""
ORACLES["flags"] = f"""WITH {CALIBRATED}
SELECT player_type, player_id, {r9("luck_z", "outlook")}, qualified, flagged, direction FROM calibrated"""
ORACLES["shrink_projection"] = f"""WITH {CALIBRATED}
SELECT player_type, player_id, {r9("league_mean_est_woba", "proj_woba_ros", "proj_vs_current")} FROM calibrated"""
ORACLES["pa_level"] = f"WITH {PITCHES},{pa_rows()} SELECT {PA_COLUMNS} FROM pa_rows"
ORACLES["pa_level_pitcher_year"] = f"""
WITH {PITCHES},{pa_rows("pitcher", "AND game_date >= DATE '2000-01-01' AND game_date <= DATE '2000-12-31'")}
SELECT {PA_COLUMNS} FROM pa_rows"""
ORACLES["recent_days_filter"] = f"""
WITH {PITCHES},{pa_rows(extra="AND game_date >= (SELECT max(game_date) FROM pitches) - INTERVAL 120 DAY")}
SELECT {PA_COLUMNS} FROM pa_rows"""
ORACLES["entity_semi"] = f"""WITH {CALIBRATED},{pa_rows()}
SELECT {PA_COLUMNS} FROM pa_rows WHERE pid IN (SELECT player_id FROM calibrated WHERE flagged AND player_type = 'batter')"""

# Joins, aggregates and ranks of the boards

ORACLES["attach_contact"] = f"""WITH {GAPPED},{CONTACT}
SELECT player_type, player_id, {r9("avg_hit_speed", "brl_percent", "ev95percent", "avg_launch_angle")}, attempts
FROM gapped LEFT JOIN contact USING (player_type, player_id)"""
ORACLES["attach_contact_repeated"] = f"""WITH {GAPPED},{CONTACT},
winners AS ({repeated("contact")} QUALIFY row_number() OVER (PARTITION BY player_type, player_id ORDER BY attempts DESC) = 1)
SELECT player_type, player_id, {r9("avg_hit_speed", "brl_percent", "ev95percent", "avg_launch_angle")}, attempts
FROM gapped LEFT JOIN winners USING (player_type, player_id)"""
ORACLES["pool_calibration"] = f"""WITH {CALIBRATED}
SELECT player_type, n_qualified, {r9("gap_mean", "gap_sd", "league_mean_est_woba")} FROM pools"""
ORACLES["pct_rank_avg"] = f"""WITH {SIGNALS}
SELECT player_type, player_id, pct_est_woba, pct_woba FROM signals WHERE qualified"""
ORACLES["pct_rank_contact"] = f"""WITH {SIGNALS}
SELECT player_type, player_id, pct_ev, pct_barrel, pct_hardhit FROM signals
WHERE qualified AND avg_hit_speed IS NOT NULL"""
ORACLES["pct_rank_events"] = f"""
WITH marked AS (SELECT *, TRUE AS qualified FROM events)
SELECT event_type, event_id, {percentile("value", "event_type")} AS pct_value FROM marked"""
ORACLES["pct_rank_wide"] = f"""
WITH prices AS (
  SELECT o_orderstatus, o_orderkey, o_totalprice AS price,
    CAST(CAST(o_orderkey AS BIGINT) * o_custkey * 1000003 AS DOUBLE) AS wide, TRUE AS qualified FROM orders)
SELECT o_orderstatus, o_orderkey, {percentile("price", "o_orderstatus")} AS pct_price, {percentile("wide", "o_orderstatus")} AS pct_wide
FROM prices"""
ORACLES["signals"] = f"WITH {SIGNALS} SELECT {', '.join(_signal_others)}, {r9(*_signal_doubles)} FROM signals"
ORACLES["signal_checks"] = f"""WITH {SIGNALS}
SELECT count(*) AS n_rows, count(DISTINCT player_type) AS n_kinds, count_if(flagged) AS n_flagged,
  count_if(abs(luck_gap - (est_woba - woba)) > 1e-8 + 1e-5 * abs(est_woba - woba)) AS bad_gap_identity,
  count_if(outlook <> CASE player_type WHEN 'batter' THEN luck_z ELSE -luck_z END) AS bad_outlook_sign,
  count_if((direction = 'positive regression') <> (outlook > 0)) AS bad_direction_label,
  count_if((proj_woba_ros - league_mean_est_woba) * (est_woba - league_mean_est_woba) < -1e-15) AS bad_projection_side,
  count_if(abs(proj_woba_ros - league_mean_est_woba) > abs(est_woba - league_mean_est_woba) + 1e-12)
    AS bad_projection_pull,
  count_if(flagged AND NOT abs(luck_z) >= 1.5) AS bad_flag_threshold,
  count_if(flagged AND NOT qualified) AS bad_flag_qualified,
  count_if(NOT pct_est_woba BETWEEN 0 AND 100 OR NOT pct_woba BETWEEN 0 AND 100) AS bad_percentile_range
FROM signals"""


def listed(direction: str) -> str:
    return f"""WITH {CALIBRATED},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY player_type ORDER BY outlook {direction} NULLS LAST, player_id) AS position
  FROM calibrated WHERE qualified)
SELECT player_type, player_id, CAST(position AS INTEGER) AS position, {r9("outlook", "luck_z", "proj_woba_ros")}, direction
FROM placed WHERE position <= {b.REPORT.top_n}"""


ORACLES["breakout_top_n"] = listed("DESC")
ORACLES["regression_top_n"] = listed("ASC")
ORACLES["ranked_all"] = f"""WITH {CALIBRATED}
SELECT player_type, player_id, {r9("est_woba", "woba")} FROM calibrated WHERE qualified"""

PICKED = f"""
placed AS (
  SELECT *, row_number() OVER (PARTITION BY player_type ORDER BY outlook DESC NULLS LAST, player_id) AS best,
    row_number() OVER (PARTITION BY player_type ORDER BY outlook ASC NULLS LAST, player_id) AS worst
  FROM calibrated WHERE qualified),
picked AS (
  SELECT player_type, player_id FROM placed
  WHERE (best <= {b.REPORT.trend_n} OR worst <= {b.REPORT.trend_n}) AND player_id <> 0)"""
ORACLES["trend_entity_pick"] = f"WITH {CALIBRATED},{PICKED} SELECT * FROM picked"
ORACLES["group_summary"] = f"""WITH {CALIBRATED}
SELECT player_type, count(*) AS n_qualified, {rounding("max(league_mean_est_woba)")} AS league_mean_est_woba
FROM calibrated WHERE qualified GROUP BY player_type"""
ORACLES["report_rows"] = f"""WITH {SIGNALS}
SELECT {", ".join(r9(c) if c in _signal_doubles else c for c in REPORT_COLUMNS)} FROM signals WHERE qualified"""
ORACLES["report_document"] = f"""WITH {CALIBRATED},{PICKED},
kinds AS (
  SELECT CASE player_type WHEN 'batter' THEN 0 ELSE 1 END AS kind_no, count(*) AS n FROM calibrated
  WHERE qualified GROUP BY player_type),
trended AS (
  SELECT CASE player_type WHEN 'batter' THEN 0 ELSE 1 END AS kind_no, count(*) AS n
  FROM picked p WHERE {b.TRENDS.warmup} <= (
    SELECT count(*) FROM pitches WHERE woba_denom = 1
      AND CASE p.player_type WHEN 'batter' THEN batter ELSE pitcher END = p.player_id)
  GROUP BY player_type),
parts AS (
  SELECT 0 AS section, 0 AS kind_no, 0 AS part, 5 AS n_lines
  UNION ALL SELECT 1, kind_no, part, n_lines FROM kinds,
    (VALUES (0, 4), (2, 2), (4, 2), (6, 2)) AS fixed(part, n_lines)
  UNION ALL SELECT 1, kind_no, part, least(n, {b.REPORT.top_n}) FROM kinds, (VALUES (1), (3)) AS lists(part)
  UNION ALL SELECT 1, kind_no, 5, n FROM kinds
  UNION ALL SELECT 2, -1, 0, 2
  UNION ALL SELECT 2, kind_no, part, 1 FROM kinds, (VALUES (0), (2)) AS ends(part)
  UNION ALL SELECT 2, kind_no, 1, n FROM trended
  UNION ALL SELECT 3, 0, 0, 2)
SELECT section, kind_no, part, CAST(n_lines AS BIGINT) AS n_lines FROM parts"""

_entry = ", ".join(r9(c) if c in _signal_doubles else c for c in REPORT_COLUMNS)
_kind_no = "CASE player_type WHEN 'batter' THEN 0 ELSE 1 END AS kind_no"
ORACLES["report_entries"] = f"""WITH {SIGNALS},
placed AS (
  SELECT *, {_kind_no}, row_number() OVER (PARTITION BY player_type ORDER BY outlook DESC NULLS LAST, player_id) AS best,
    row_number() OVER (PARTITION BY player_type ORDER BY outlook ASC NULLS LAST, player_id) AS worst
  FROM signals WHERE qualified)
SELECT kind_no, 1 AS part, CAST(best AS INTEGER) AS place, {_entry} FROM placed WHERE best <= {b.REPORT.top_n}
UNION ALL SELECT kind_no, 3, CAST(worst AS INTEGER), {_entry} FROM placed WHERE worst <= {b.REPORT.top_n}
UNION ALL SELECT kind_no, 5, NULL, {_entry} FROM placed"""
ORACLES["null_safe_values"] = f"""WITH {GAPPED},{CONTACT}
SELECT player_type, player_id, player_name, pa, {", ".join(
    f"CASE WHEN (player_id + {i}) % 4 <> 0 THEN {rounding(c)} END AS {c}" for i, c in enumerate(("woba", "est_woba", "luck_gap", "avg_hit_speed")))},
  {r9("brl_percent")}, qualified
FROM gapped LEFT JOIN contact USING (player_type, player_id)"""


def refreshed(kind: str) -> str:
    """Signals of one kind from its board; the contact board has its own minimum."""
    p = getattr(b.SIGNALS, kind)
    return f"""known_{kind} AS (
  SELECT '{kind}' AS player_type, player_id, {BOARD_NAMES[kind]} AS player_name, pa, woba, est_woba, est_woba - woba AS gap,
    CASE WHEN attempts >= 30 THEN avg_hit_speed END AS avg_hit_speed, pa >= {p.min_pa} AS qualified
  FROM board_{kind} WHERE pa >= 50),
pool_{kind} AS (
  SELECT CASE WHEN count_if(qualified) > 5 THEN avg(gap) FILTER (qualified) ELSE avg(gap) END AS mu,
    CASE WHEN count_if(qualified) > 5 THEN stddev_samp(gap) FILTER (qualified) ELSE stddev_samp(gap) END AS sd,
    CASE WHEN count_if(qualified) > 5 THEN avg(est_woba) FILTER (qualified) ELSE avg(est_woba) END AS league
  FROM known_{kind}),
judged_{kind} AS (
  SELECT k.*, CASE WHEN sd > 0 THEN (gap - mu) / sd END AS luck_z, CASE WHEN sd > 0 THEN (gap - mu) / sd END * {p.direction} AS outlook,
    (est_woba * pa + league * {p.shrink_pa}) / (pa + {p.shrink_pa}) AS proj_woba_ros,
    {percentile("woba")} AS pct_woba, {percentile("avg_hit_speed")} AS pct_ev
  FROM known_{kind} k, pool_{kind}),
ranked_{kind} AS (
  SELECT *, row_number() OVER (ORDER BY outlook DESC NULLS LAST, player_id) AS best, row_number() OVER (ORDER BY outlook NULLS LAST, player_id) AS worst
  FROM judged_{kind} WHERE qualified)"""


ORACLES["refresh_pipeline"] = f"""WITH {BOARDS},{refreshed("batter")},{refreshed("pitcher")},
entries AS (SELECT * FROM ranked_batter UNION ALL SELECT * FROM ranked_pitcher),
extent AS (SELECT max(game_date) AS hi FROM pitches)
SELECT player_type, player_id, CAST(1 + CAST(best <= {b.REPORT.top_n} AS INTEGER) + CAST(worst <= {b.REPORT.top_n} AS INTEGER) AS BIGINT) AS times,
  player_name, pa, {r9("woba", "est_woba", "luck_z", "outlook", "proj_woba_ros", "pct_woba", "pct_ev")}, CAST(NULL AS DATE) AS day
FROM entries
UNION ALL
SELECT 'ledger', NULL, coalesce(n, 0), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, day
FROM (SELECT CAST(unnest(generate_series(hi - 29, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM extent)
  LEFT JOIN (SELECT game_date AS day, count(*) AS n FROM pitches GROUP BY game_date) USING (day)"""

# Trends


def rolled(role: str) -> str:
    frame = f"OVER (PARTITION BY pid ORDER BY {EVENT_ORDER} ROWS BETWEEN {b.TRENDS.window - 1} PRECEDING AND CURRENT ROW)"
    return f"""{pa_rows(role)},
rolled AS (
  SELECT pid, game_date, game_pk, at_bat_number, opponent,
    row_number() OVER (PARTITION BY pid ORDER BY {EVENT_ORDER}) - 1 AS ordinal,
    count(*) OVER (PARTITION BY pid) AS n_rows,
    CASE WHEN count(xwoba_pa) {frame} >= {b.TRENDS.warmup} THEN avg(xwoba_pa) {frame} END AS x_roll,
    CASE WHEN count(woba_pa) {frame} >= {b.TRENDS.warmup} THEN avg(woba_pa) {frame} END AS w_roll,
    CASE WHEN count(launch_speed) {frame} >= {b.TRENDS.contact_minimum} THEN avg(launch_speed) {frame} END AS ev_roll
  FROM pa_rows)"""


ORACLES["entity_ordinals"] = f"""WITH {PITCHES},{rolled("batter")}
SELECT pid, game_date, game_pk, at_bat_number, opponent, ordinal, n_rows FROM rolled"""
ORACLES["rolling_mean_rows"] = f"""WITH {PITCHES},{rolled("batter")}
SELECT pid, game_date, ordinal, {r9("x_roll", "w_roll")} FROM rolled"""
ORACLES["rolling_mean_sparse"] = f"""WITH {PITCHES},{rolled("pitcher")}
SELECT pid, game_date, ordinal, {r9("ev_roll")} FROM rolled"""


def points(restrict: str = "") -> str:
    return f"""
warm AS (
  SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ordinal) - 1 AS i, count(*) OVER (PARTITION BY pid) AS n
  FROM rolled WHERE x_roll IS NOT NULL {restrict})
SELECT pid, game_date AS d, i AS pa, {decimal_even("x_roll", 4)} AS x, {decimal_even("w_roll", 4)} AS w,
  {decimal_even("ev_roll", 1)} AS ev
FROM warm WHERE i % greatest(1, n // {b.TRENDS.points}) = 0 OR i = n - 1"""


ORACLES["rolling_trends"] = f"WITH {PITCHES},{rolled('batter')},{points()}"
ORACLES["flagged_trends"] = f"""WITH {CALIBRATED},{PICKED},{rolled("pitcher")},
{points("AND pid IN (SELECT player_id FROM picked WHERE player_type = 'pitcher')")}"""

ORACLES["rolling_mean_hot"] = f"""WITH {PITCHES.replace("l_suppkey AS batter", "CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey END AS batter")},{rolled("batter")}
SELECT pid, game_date, ordinal, n_rows, {r9("x_roll", "w_roll", "ev_roll")} FROM rolled"""


def listed_points(role: str, kind_no: int) -> str:
    return f"""(WITH {rolled(role)},{points(f"AND pid IN (SELECT player_id FROM picked WHERE player_type = '{role}')").replace("SELECT pid, game_date", f"SELECT {kind_no} AS kind_no, pid, game_date")})"""


ORACLES["report_trends"] = f"""WITH {CALIBRATED},{PICKED}
SELECT * FROM {listed_points("batter", 0)} UNION ALL SELECT * FROM {listed_points("pitcher", 1)}"""

# Splits

DETAILED = """
detailed AS (
  SELECT l_suppkey AS batter, l_partkey AS pitcher, l_linenumber % 4 AS balls,
    CASE WHEN l_quantity <= 48 THEN CAST(l_quantity AS INTEGER) % 3 END AS strikes,
    CASE l_orderkey % 5 WHEN 0 THEN 'FF' WHEN 1 THEN 'SL' WHEN 2 THEN 'CH' WHEN 3 THEN 'CU' END AS pitch_type,
    CASE WHEN l_partkey % 50 = 0 THEN 'R' WHEN l_suppkey % 3 = 0 THEN 'L' ELSE 'R' END AS stand,
    CASE WHEN l_suppkey % 10 = 0 THEN CASE WHEN l_quantity > 25 THEN 'L' END WHEN l_partkey % 3 = 0 THEN 'L' ELSE 'R' END AS p_throws,
    NOT (l_returnflag = 'N' AND l_linestatus = 'O') AS completed,
    CASE WHEN l_quantity <= 48 THEN CAST(round(l_tax * 100) AS INTEGER) * 13 / 256::DOUBLE ELSE 0 END AS w,
    CASE WHEN l_returnflag <> 'R' THEN CAST(round(l_discount * 100) AS INTEGER) * 41 / 1024::DOUBLE END AS contact
  FROM lineitem),
valued AS (SELECT *, coalesce(contact, w) AS x FROM detailed)"""

ORACLES["count_state_splits"] = f"""WITH {DETAILED},
states AS (
  SELECT batter AS pid, balls, strikes, 0 AS level, w, x FROM valued WHERE completed
  UNION ALL SELECT batter, balls, NULL, 1, w, x FROM valued WHERE completed
  UNION ALL SELECT batter, NULL, strikes, 2, w, x FROM valued WHERE completed
  UNION ALL SELECT batter, NULL, NULL, 3, w, x FROM valued WHERE completed),
rates AS (
  SELECT pid, balls, strikes, level, count(*) AS n, avg(w) AS woba, avg(x) AS est_woba FROM states GROUP BY pid, balls, strikes, level)
SELECT pid, balls, strikes, level, n, {r9("woba", "est_woba")}, {rounding("est_woba - woba")} AS gap FROM rates"""
ORACLES["pitch_type_mix"] = f"""WITH {DETAILED},
typed AS (SELECT pitcher AS pid, pitch_type, completed, x FROM valued WHERE pitch_type IS NOT NULL),
kind AS (SELECT avg(x) AS kind_rate FROM typed WHERE completed),
entities AS (
  SELECT pid, count(*) AS n, (coalesce(sum(x) FILTER (completed), 0) + any_value(kind_rate) * 250) / (count(*) FILTER (completed) + 250) AS rate
  FROM typed, kind GROUP BY pid),
types AS (
  SELECT pid, pitch_type, count(*) AS k, count(*) FILTER (completed) AS n_pa, coalesce(sum(x) FILTER (completed), 0) AS s FROM typed GROUP BY pid, pitch_type)
SELECT pid, n, {r9("rate")}, pitch_type, {rounding("k / CAST(n AS DOUBLE)")} AS share, n_pa, {rounding("(s + rate * 50) / (n_pa + 50)")} AS type_rate
FROM entities JOIN types USING (pid)"""


def platoon(role: str, side: str) -> str:
    return f"""SELECT '{role}' AS role, {role} AS pid, count(*) FILTER ({side} = 'L') AS n_left, count(*) FILTER ({side} = 'R') AS n_right,
    avg(w) FILTER ({side} = 'L') AS left_rate, avg(w) FILTER ({side} = 'R') AS right_rate,
    var_samp(w) FILTER ({side} = 'L') AS var_left, var_samp(w) FILTER ({side} = 'R') AS var_right
  FROM valued WHERE completed AND {side} IS NOT NULL GROUP BY {role}"""


PLATOON = f"""{DETAILED},
sides AS ({platoon("batter", "p_throws")} UNION ALL {platoon("pitcher", "stand")}),
platoons AS (SELECT *, left_rate - right_rate AS difference, var_left / n_left + var_right / n_right AS variance FROM sides)"""
ORACLES["platoon_splits"] = f"""WITH {PLATOON}
SELECT role, pid, n_left, n_right, {r9("left_rate", "right_rate", "difference", "variance")},
  {rounding("difference / sqrt(nullif(variance, 0))")} AS z FROM platoons"""
ORACLES["platoon_summary"] = f"""WITH {PLATOON},
weighted AS (SELECT *, n_left * n_right / CAST(n_left + n_right AS DOUBLE) AS weight FROM platoons WHERE role = 'batter' AND variance IS NOT NULL),
total AS (
  SELECT count(*) AS n_entities, sum(weight * difference) / sum(weight) AS difference,
    sum(weight * weight * variance) / pow(sum(weight), 2) AS variance
  FROM weighted)
SELECT n_entities, {r9("difference", "variance")}, {rounding("difference / sqrt(variance)")} AS z FROM total"""

# Validation study


def pairs(windows: tuple[int, ...] = b.STUDY.windows, min_pa: int = b.STUDY.min_pa, role: str = "batter", extra: str = "") -> str:
    return f"""{PITCHES},{pa_rows(role, extra)},
extent AS (SELECT min(game_date) AS lo, max(game_date) AS hi FROM pitches),
windows AS (SELECT unnest([{", ".join(str(w) for w in windows)}]) AS win),
blocks AS (
  SELECT win, half, lo + CAST(half * win AS INTEGER) AS a, lo + CAST((half + 1) * win AS INTEGER) AS m,
    lo + CAST((half + 2) * win AS INTEGER) AS z
  FROM extent, windows, (SELECT unnest(range(0, 1000)) AS half)
  WHERE lo + CAST((half + 2) * win AS INTEGER) <= hi + 1),
first_half AS (
  SELECT win, half, a AS block_start, pid, count(*) AS pa_1, avg(woba_pa) AS woba_1, avg(xwoba_pa) AS xwoba_1
  FROM blocks JOIN pa_rows ON game_date >= a AND game_date < m GROUP BY ALL),
second_half AS (
  SELECT win, half, pid, count(*) AS pa_2, avg(woba_pa) AS woba_2, avg(xwoba_pa) AS xwoba_2
  FROM blocks JOIN pa_rows ON game_date >= m AND game_date < z GROUP BY ALL),
pairs AS (
  SELECT * FROM first_half JOIN second_half USING (win, half, pid)
  WHERE pa_1 >= {min_pa} AND pa_2 >= {min_pa}
  QUALIFY count(*) OVER (PARTITION BY win, half) >= {b.STUDY.min_pairs})"""


PAIRS = pairs()
_windows = ", ".join(str(w) for w in b.STUDY.windows)


def numbered(source: str) -> str:
    return f"""{source},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY half, pid % 1021, pid) - 1 AS idx,
    row_number() OVER (PARTITION BY win, half ORDER BY pid % 1021, pid) - 1 AS blk_idx,
    count(*) OVER (PARTITION BY win) AS n, count(*) OVER (PARTITION BY win, half) AS n_block
  FROM pairs)"""


NUMBERED = numbered(PAIRS)

ORACLES["table_extent"] = f"""WITH {PITCHES}
SELECT min(game_date) AS first_day, max(game_date) AS last_day, count(*) AS n_rows FROM pitches"""
ORACLES["eligible_entities"] = f"""WITH {PITCHES}
SELECT pitcher AS pid, count(*) AS n_pa FROM pitches WHERE woba_denom = 1 GROUP BY pitcher HAVING count(*) >= 20"""
ORACLES["half_aggregate"] = f"""WITH {PITCHES},{pa_rows()},
windows AS (SELECT unnest([{_windows}]) AS win),
halves AS (
  SELECT win, CAST((game_date - (SELECT min(game_date) FROM pitches)) // win AS BIGINT) AS half, pid, count(*) AS pa,
    avg(woba_pa) AS woba, avg(xwoba_pa) AS xwoba
  FROM pa_rows, windows GROUP BY ALL)
SELECT win, half, pid, pa, {r9("woba", "xwoba")} FROM halves"""
ORACLES["block_pairs"] = f"""WITH {PAIRS}
SELECT win, half, block_start, pid, pa_1, {r9("woba_1", "xwoba_1")}, pa_2, {r9("woba_2", "xwoba_2")} FROM pairs"""
ORACLES["index_pairs"] = f"WITH {NUMBERED} SELECT win, half, pid, idx, blk_idx, n, n_block FROM numbered"


def statistics(source: str, keys: str) -> str:
    return f"""
moments AS (
  SELECT {keys}, count(*) AS n, stddev_samp(woba_1) AS sd_w1, stddev_samp(xwoba_1) AS sd_x1,
    corr(woba_1, woba_2) AS r_w, corr(xwoba_1, woba_2) AS r_x, corr(woba_1, xwoba_1) AS r_wx,
    regr_slope(woba_2 - woba_1, xwoba_1 - woba_1) AS b_coupled,
    sqrt(avg(pow(woba_1 - woba_2, 2))) AS rmse_w, sqrt(avg(pow(xwoba_1 - woba_2, 2))) AS rmse_x
  FROM {source} GROUP BY {keys}),
stats AS (
  SELECT *, r_x - r_w AS dr, (r_x - r_w * r_wx) / (1 - r_wx * r_wx) AS b_partial FROM moments)"""


_stat_columns = r9("sd_w1", "sd_x1", "r_w", "r_x", "dr", "b_partial", "b_coupled", "rmse_w", "rmse_x")


def draw(kind: str, of: str = "win || '|' || rep || '|' || idx") -> str:
    text = f"'{b.STUDY.seed}|{kind}|' || {of}"
    return f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) / {float(1 << 48):.0f}::DOUBLE"


def boot(replicates: int = b.STUDY.bootstrap) -> str:
    return f"""
reps AS (SELECT unnest(range(0, {replicates})) AS rep),
draws AS (SELECT win, rep, CAST(floor({draw("boot")} * n) AS BIGINT) AS idx FROM numbered, reps),
resampled AS (SELECT rep, numbered.* FROM draws JOIN numbered USING (win, idx)),
{statistics("resampled", "win, rep")}"""


BOOT = f"{NUMBERED},{boot()}"
# Every pair as often as its Poisson(1) number says.
POISSON = f"""{PAIRS},
reps AS (SELECT unnest(range(0, {b.STUDY.bootstrap})) AS rep),
drawn AS (SELECT *, {draw("poisson", "win || '|' || half || '|' || pid || '|' || rep")} AS u FROM pairs, reps),
chances AS (
  SELECT k, exp(-1) * sum(1 / CAST(factorial(CAST(k AS INTEGER)) AS DOUBLE)) OVER (ORDER BY k) AS p FROM (SELECT unnest(range(0, 17)) AS k)),
resampled AS (SELECT drawn.* FROM drawn JOIN chances ON u >= p),
{statistics("resampled", "win, rep")}"""
BOOT_CI = """
boot AS (
  SELECT win, count(*) AS n_boot, quantile_cont(dr, 0.025) AS dr_lo, quantile_cont(dr, 0.975) AS dr_hi,
    quantile_cont(b_partial, 0.025) AS bp_lo, quantile_cont(b_partial, 0.975) AS bp_hi
  FROM stats GROUP BY win)"""


def shuffled(replicates: int) -> str:
    return f"""
perms AS (SELECT unnest(range(0, {replicates})) AS rep),
placed AS (
  SELECT rep, win, half, blk_idx, xwoba_1,
    row_number() OVER (PARTITION BY rep, win, half ORDER BY {draw("perm")}, idx) - 1 AS pos
  FROM numbered, perms)"""


def perm(replicates: int = b.STUDY.permutations) -> str:
    return f"""{shuffled(replicates)},
permuted AS (
  SELECT p.rep, k.win, k.woba_1, k.woba_2, p.xwoba_1
  FROM placed p JOIN numbered k ON p.win = k.win AND p.half = k.half AND p.pos = k.blk_idx),
slopes AS (
  SELECT win, rep, regr_slope(woba_2 - woba_1, xwoba_1 - woba_1) AS b_coupled FROM permuted GROUP BY win, rep)"""


PERM = perm()
PERM_NULL = """
null_counts AS (
  SELECT win, count(s.b_coupled) AS n_perm, avg(s.b_coupled) AS null_mean, quantile_cont(s.b_coupled, 0.975) AS null_hi,
    count(*) FILTER (s.b_coupled >= o.slope) AS n_above, count(*) FILTER (s.b_coupled <= o.slope) AS n_below
  FROM slopes s JOIN (SELECT win, regr_slope(woba_2 - woba_1, xwoba_1 - woba_1) AS slope FROM pairs GROUP BY win) o USING (win)
  GROUP BY win),
null_band AS (
  SELECT *, (1 + n_above) / CAST(1 + n_perm AS DOUBLE) AS p_above, (1 + n_below) / CAST(1 + n_perm AS DOUBLE) AS p_below,
    least(1.0, 2 * (1 + least(n_above, n_below)) / CAST(1 + n_perm AS DOUBLE)) AS p_both
  FROM null_counts)"""
NULL_COLUMNS = f"n_perm, {r9('null_mean', 'null_hi')}, n_above, n_below, {r9('p_above', 'p_below', 'p_both')}"

ORACLES["predictive_stats"] = f"WITH {PAIRS},{statistics('pairs', 'win')} SELECT win, n, {_stat_columns} FROM stats"
ORACLES["bootstrap_replicates"] = f"WITH {BOOT} SELECT win, rep, n, {_stat_columns} FROM stats"
ORACLES["bootstrap_ci"] = f"WITH {BOOT},{BOOT_CI} SELECT win, n_boot, {r9('dr_lo', 'dr_hi', 'bp_lo', 'bp_hi')} FROM boot"
ORACLES["null_shuffle_rank"] = f"WITH {NUMBERED},{shuffled(5)} SELECT rep, win, half, blk_idx, pos FROM placed"
ORACLES["permutation_replicates"] = f"WITH {NUMBERED},{PERM} SELECT win, rep, {r9('b_coupled')} FROM slopes"
ORACLES["permutation_null"] = f"""WITH {NUMBERED},{PERM},{PERM_NULL}
SELECT win, {NULL_COLUMNS} FROM null_band"""


def study(source: str, bootstrap: int, permutations: int) -> str:
    resampled = boot(bootstrap).replace("stats AS", "boot_stats AS").replace("moments", "boot_moments")
    return f"""
WITH {numbered(source)},{resampled},
{BOOT_CI.replace("FROM stats", "FROM boot_stats")},{perm(permutations)},{PERM_NULL},{statistics("pairs", "win")},
counted AS (SELECT win, count(DISTINCT half) AS n_blocks FROM pairs GROUP BY win)
SELECT CAST(w.win AS INTEGER) AS win, n_blocks, n, {r9("r_w", "r_x", "dr", "b_partial", "b_coupled", "rmse_w", "rmse_x")},
  n_boot, {r9("dr_lo", "dr_hi", "bp_lo", "bp_hi")}, {NULL_COLUMNS},
  CASE WHEN n_blocks IS NULL THEN 'not enough paired blocks' ELSE
    CASE WHEN dr_lo IS NULL THEN 'inconclusive' WHEN dr_lo > 0 THEN 'xwOBA wins' WHEN dr_hi < 0 THEN 'wOBA wins'
      ELSE 'no evidence' END
    || CASE WHEN n_blocks < 3 THEN ' (only ' || n_blocks || ' blk)' ELSE '' END END AS verdict
FROM windows w LEFT JOIN counted USING (win) LEFT JOIN stats USING (win) LEFT JOIN boot USING (win)
  LEFT JOIN null_band USING (win)"""


ORACLES["validation_study"] = study(PAIRS, b.STUDY.bootstrap, b.STUDY.permutations)
ORACLES["validation_study_year"] = study(
    pairs(b.SHORT_WINDOWS, 5, extra=f"AND game_date BETWEEN DATE '{b.STUDY_YEAR}-01-01' AND DATE '{b.STUDY_YEAR}-12-31'"), 20, 20
)
ORACLES["validation_study_pitcher"] = study(pairs(min_pa=5, role="pitcher"), 20, 20)
ORACLES["poisson_replicates"] = f"WITH {POISSON} SELECT win, rep, n, {_stat_columns} FROM stats"
ORACLES["poisson_ci"] = f"WITH {POISSON},{BOOT_CI} SELECT win, n_boot, {r9('dr_lo', 'dr_hi', 'bp_lo', 'bp_hi')} FROM boot"
ORACLES["window_sweep_empty"] = f"""
WITH {PAIRS.replace(f"[{_windows}]", "[720, 2000, 3000]")},
counted AS (SELECT win, count(DISTINCT half) AS n_blocks, count(*) AS n FROM pairs GROUP BY win)
SELECT CAST(w.win AS INTEGER) AS win, coalesce(n_blocks, 0) AS n_blocks, coalesce(n, 0) AS n, n IS NULL AS is_empty
FROM windows w LEFT JOIN counted USING (win)"""
