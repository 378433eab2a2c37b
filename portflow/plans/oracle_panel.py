"""DuckDB oracle SQL for the panel layer (written from the rules, not from the Spark code)."""

from __future__ import annotations

from portflow.plans import queries_analytics, queries_snapshots  # noqa: F401  (their CTEs are used here)
from portflow.plans.oracle_base import cte, with_ctes


def signed(x: str) -> str:
    """Python ``f"{x:+.1f}%"``."""
    return f"((CASE WHEN {x} >= 0 THEN '+' ELSE '' END) || printf('%.1f', {x}) || '%')"


cte("pd_", ("daily",), "SELECT service_date, COALESCE(rows_count, 0) AS rows_count, COALESCE(total_passengers, 0) AS total_passengers, "
    "COALESCE(total_vehicles, 0) AS total_vehicles FROM daily WHERE service_date IS NOT NULL")
cte("pr_", ("routes",), "SELECT service_date, COALESCE(departure_port, 'Unknown') AS departure_port, "
    "COALESCE(arrival_port, 'Unknown') AS arrival_port, CAST(COALESCE(total_passengers, 0) AS BIGINT) AS total_passengers, "
    "CAST(COALESCE(total_vehicles, 0) AS BIGINT) AS total_vehicles FROM routes WHERE service_date IS NOT NULL")
cte("pp_", ("ports",), "SELECT service_date, COALESCE(port_name, 'Unknown') AS port_name, "
    "CAST(COALESCE(total_departing_passengers, 0) + COALESCE(total_arriving_passengers, 0) AS BIGINT) AS total_passengers "
    "FROM ports WHERE service_date IS NOT NULL")
cte("prk", ("pd_",), "SELECT *, row_number() OVER (ORDER BY service_date DESC) AS rn FROM pd_")
cte("pkb", ("pd_",), "SELECT greatest(MIN(service_date), MAX(service_date) - 6) AS kpi_start, MAX(service_date) AS end_date, "
    "MIN(service_date) AS view_start FROM pd_")
cte("prk_k", ("pr_", "pkb"), "SELECT pr_.* FROM pr_, pkb WHERE service_date BETWEEN kpi_start AND end_date")
cte("ppk_k", ("pp_", "pkb"), "SELECT pp_.* FROM pp_, pkb WHERE service_date BETWEEN kpi_start AND end_date")
cte(
    "pk",
    ("prk", "pkb", "prk_k"),
    """
    SELECT n_rows, passengers, vehicles, traffic_rows,
           (SELECT COUNT(*) FROM (SELECT DISTINCT departure_port, arrival_port FROM prk_k)) AS active_corridors,
           CASE WHEN peak > 0 THEN least(rr7 / peak * 100.0, 100.0) ELSE 0.0 END AS congestion_raw,
           COALESCE(r7, 0.0) AS recent_7d, CASE WHEN n_rows >= 14 THEN p7 END AS prior_7d,
           CASE WHEN n_rows >= 30 THEN r30 END AS recent_30d, CASE WHEN n_rows >= 60 THEN p30 END AS prior_30d
    FROM (SELECT COUNT(*) AS n_rows,
                 CAST(COALESCE(SUM(CASE WHEN service_date BETWEEN kpi_start AND end_date THEN total_passengers END), 0) AS BIGINT) AS passengers,
                 CAST(COALESCE(SUM(CASE WHEN service_date BETWEEN kpi_start AND end_date THEN total_vehicles END), 0) AS BIGINT) AS vehicles,
                 CAST(COALESCE(SUM(CASE WHEN service_date BETWEEN kpi_start AND end_date THEN rows_count END), 0) AS BIGINT) AS traffic_rows,
                 AVG(CASE WHEN rn <= 7 THEN CAST(rows_count AS DOUBLE) END) AS rr7,
                 quantile_cont(CAST(rows_count AS DOUBLE), 0.95) AS peak,
                 AVG(CASE WHEN rn <= 7 THEN CAST(total_passengers AS DOUBLE) END) AS r7,
                 AVG(CASE WHEN rn BETWEEN 8 AND 14 THEN CAST(total_passengers AS DOUBLE) END) AS p7,
                 AVG(CASE WHEN rn <= 30 THEN CAST(total_passengers AS DOUBLE) END) AS r30,
                 AVG(CASE WHEN rn BETWEEN 31 AND 60 THEN CAST(total_passengers AS DOUBLE) END) AS p30
          FROM prk, pkb)
    """,
)
cte(
    "ptc",
    ("prk_k", "pk"),
    """
    SELECT row_number() OVER (ORDER BY passengers DESC, vehicles DESC, departure_port, arrival_port) AS rank,
           departure_port || ' -> ' || arrival_port AS pair_label, passengers, vehicles,
           round(CASE WHEN (SELECT passengers FROM pk) > 0 THEN CAST(passengers AS DOUBLE) / CAST((SELECT passengers FROM pk) AS DOUBLE) * 100.0
                      ELSE 0.0 END, 1) AS share_pct
    FROM (SELECT departure_port, arrival_port, CAST(SUM(total_passengers) AS BIGINT) AS passengers,
                 CAST(SUM(total_vehicles) AS BIGINT) AS vehicles FROM prk_k GROUP BY ALL
          ORDER BY passengers DESC, vehicles DESC, departure_port, arrival_port LIMIT 5)
    """,
)
cte(
    "ptp",
    ("ppk_k",),
    """
    SELECT row_number() OVER (ORDER BY passengers DESC, port_name) AS rank, port_name, passengers
    FROM (SELECT port_name, CAST(SUM(total_passengers) AS BIGINT) AS passengers FROM ppk_k GROUP BY ALL
          ORDER BY passengers DESC, port_name LIMIT 5)
    """,
)
cte(
    "pprev",
    ("pr_", "pkb"),
    """
    SELECT (SELECT departure_port || ' -> ' || arrival_port FROM (
              SELECT departure_port, arrival_port, SUM(total_passengers) AS p FROM pr_, pkb
              WHERE service_date BETWEEN end_date - 13 AND end_date - 7 GROUP BY ALL
              ORDER BY p DESC, departure_port, arrival_port LIMIT 1)) AS previous_top_corridor_label
    """,
)


def _delta(ordn: int, name: str, label: str, period: str, cur: str, prev: str) -> str:
    pct = f"(CASE WHEN {cur} IS NOT NULL AND {prev} IS NOT NULL AND {prev} > 0 THEN ({cur} - {prev}) / {prev} * 100.0 END)"
    return f"""
    SELECT {ordn} AS ord, '{name}' AS name, '{label}' AS label, '{period}' AS period,
           CASE WHEN {pct} IS NULL THEN 'unknown' WHEN {pct} > 1.0 THEN 'up' WHEN {pct} < -1.0 THEN 'down' ELSE 'flat' END AS direction,
           CASE WHEN {pct} IS NULL THEN 'info' WHEN abs({pct}) >= 20.0 THEN 'alert' WHEN abs({pct}) >= 10.0 THEN 'watch' ELSE 'info' END AS severity,
           {pct} AS value_pct,
           CASE WHEN {pct} IS NULL THEN '{label}: insufficient history for a {period} comparison.'
                ELSE '{label}: ' || {signed(pct)} || ' versus the prior {period}.' END AS summary
    FROM pk WHERE n_rows > 0"""


cte("pdelta", ("pk",), _delta(1, "passengers_7d_avg", "7-day average passengers", "7-day window", "recent_7d", "prior_7d")
    + " UNION ALL " + _delta(2, "passengers_30d_avg", "30-day average passengers", "30-day window", "recent_30d", "prior_30d"))

cte(
    "psig_all",
    ("pdelta", "ptc", "pprev", "pk"),
    """
    SELECT ord, name AS kind, severity, summary FROM pdelta
    UNION ALL
    SELECT 10, 'corridor_concentration',
           CASE WHEN share_pct >= 45 THEN 'alert' WHEN share_pct >= 30 THEN 'watch' ELSE 'info' END,
           'Top corridor concentration: ' || pair_label || ' carries ' || printf('%.1f', share_pct) || '% of current-period passengers.'
    FROM ptc WHERE rank = 1
    UNION ALL
    SELECT 11, 'corridor_shift',
           CASE WHEN p.previous_top_corridor_label = t.pair_label THEN 'info' ELSE 'watch' END,
           CASE WHEN p.previous_top_corridor_label = t.pair_label
                THEN 'Corridor leader is stable: ' || t.pair_label || ' remains first across the last two weekly windows.'
                ELSE 'Corridor rotation detected: leader moved from ' || p.previous_top_corridor_label || ' to ' || t.pair_label
                     || ' in the latest weekly window.' END
    FROM ptc t, pprev p WHERE t.rank = 1 AND p.previous_top_corridor_label IS NOT NULL AND p.previous_top_corridor_label <> ''
    UNION ALL
    SELECT 12, 'congestion',
           CASE WHEN round(congestion_raw, 1) >= 90 THEN 'alert' WHEN round(congestion_raw, 1) >= 75 THEN 'watch' ELSE 'info' END,
           'Congestion index is ' || printf('%.0f', round(congestion_raw, 1)) || '% versus the 95th percentile traffic-row baseline.'
    FROM pk WHERE n_rows > 0
    """,
)
cte(
    "psig",
    ("psig_all",),
    """
    SELECT row_number() OVER (ORDER BY ord) AS ord, kind, severity, summary FROM (
      SELECT * FROM psig_all QUALIFY row_number() OVER (PARTITION BY summary ORDER BY ord) = 1)
    QUALIFY row_number() OVER (ORDER BY ord) <= 8
    """,
)
_R_DROP = ("A large weekly contraction can reflect schedule suppression, displaced demand, or data latency that needs "
           "confirmation before action.")
_R_RISE = "A sharp weekly expansion can create staffing and berth pressure if it persists into the next reporting window."
_R_CONC = "High corridor concentration increases operational sensitivity to one route''s schedule changes or reporting gaps."
_R_ROT = ("A new lead corridor should be checked against schedule changes and recent demand redistribution before it is "
          "treated as a durable shift.")
_R_MON = ("The current snapshot does not justify escalation, but the next update should confirm whether recent demand "
          "patterns persist or revert.")
cte(
    "pact_c",
    ("pdelta", "ptc", "ptp", "pprev"),
    f"""
    SELECT 1 AS ord, CASE WHEN d.value_pct <= -20 THEN 'Investigate the demand drop on ' || COALESCE((SELECT pair_label FROM ptc WHERE rank = 1), 'the leading corridors') || '.'
                          ELSE 'Validate berth and vessel capacity around ' || COALESCE((SELECT port_name FROM ptp WHERE rank = 1), 'the busiest ports') || '.' END AS action,
           CASE WHEN d.value_pct <= -20 THEN '{_R_DROP}' ELSE '{_R_RISE}' END AS rationale, 'investigate' AS priority
    FROM pdelta d WHERE d.ord = 1 AND (d.value_pct <= -20 OR d.value_pct >= 20)
    UNION ALL
    SELECT 2, 'Review concentration risk on ' || pair_label || '.', '{_R_CONC}', 'escalate' FROM ptc WHERE rank = 1 AND share_pct >= 45
    UNION ALL
    SELECT 3, 'Confirm the corridor rotation into ' || t.pair_label || '.', '{_R_ROT}', 'monitor'
    FROM ptc t, pprev p WHERE t.rank = 1 AND p.previous_top_corridor_label IS NOT NULL AND p.previous_top_corridor_label <> ''
      AND p.previous_top_corridor_label <> t.pair_label
    """,
)
cte(
    "pact",
    ("pact_c", "ptp", "pk"),
    f"""
    SELECT row_number() OVER (ORDER BY ord) AS ord, action, rationale, priority FROM (
      SELECT * FROM (
        SELECT * FROM pact_c WHERE (SELECT n_rows FROM pk) > 0
        UNION ALL
        SELECT 9, 'Monitor the next ingestion window for ' || COALESCE((SELECT port_name FROM ptp WHERE rank = 1), 'the network') || '.',
               '{_R_MON}', 'monitor'
        WHERE (SELECT n_rows FROM pk) > 0 AND NOT EXISTS (SELECT 1 FROM pact_c)
        UNION ALL
        SELECT 0, 'Validate upstream ingestion before publishing commentary.',
               'The reporting snapshot is empty, so any narrative would be unreliable.', 'escalate'
        WHERE (SELECT n_rows FROM pk) = 0)
      QUALIFY row_number() OVER (PARTITION BY action ORDER BY ord) = 1)
    QUALIFY row_number() OVER (ORDER BY ord) <= 4
    """,
)

NOTABLE_SQL = with_ctes(
    f"""
    SELECT len(reasons) > 0 AS should_trigger, reasons FROM (
      SELECT list_filter([r1, r2], lambda x: x IS NOT NULL) AS reasons FROM (
        SELECT CASE WHEN n >= 14 AND prior > 0 AND abs((recent - prior) / prior * 100.0) >= 5.0 AND recent >= 1000.0
                    THEN '7-day passenger average changed ' || {signed('((recent - prior) / prior * 100.0)')} || ' vs prior week' END AS r1,
               CASE WHEN COALESCE(tot, 0) > 0 AND CAST(top AS DOUBLE) / CAST(tot AS DOUBLE) * 100.0 >= 45.0
                    THEN 'Top corridor concentration reached ' || printf('%.1f', CAST(top AS DOUBLE) / CAST(tot AS DOUBLE) * 100.0) || '%' END AS r2
        FROM (SELECT COUNT(*) AS n, AVG(CASE WHEN rn <= 7 THEN CAST(total_passengers AS DOUBLE) END) AS recent,
                     AVG(CASE WHEN rn BETWEEN 8 AND 14 THEN CAST(total_passengers AS DOUBLE) END) AS prior FROM prk),
             (SELECT MAX(p) AS top, SUM(p) AS tot FROM (
                SELECT departure_port, arrival_port, COALESCE(SUM(total_passengers), 0) AS p FROM routes
                WHERE departure_port IS NOT NULL AND arrival_port IS NOT NULL GROUP BY ALL))))
    """,
    "prk", "routes",
)

SCOPE_SQL = with_ctes(
    """
    SELECT CASE WHEN end_date IS NULL THEN 'unknown' WHEN has THEN CAST(b_start AS VARCHAR) ELSE CAST(view_start AS VARCHAR) END AS baseline_start,
           CASE WHEN end_date IS NULL THEN 'unknown' WHEN has THEN CAST(b_end AS VARCHAR) ELSE CAST(view_start AS VARCHAR) END AS baseline_end,
           COALESCE(CAST(kpi_start AS VARCHAR), 'unknown') AS kpi_start, COALESCE(CAST(end_date AS VARCHAR), 'unknown') AS kpi_end,
           CASE WHEN end_date IS NULL OR NOT has THEN 'No comparison baseline available'
                ELSE strftime(b_start, '%d %b %Y') || ' -> ' || strftime(b_end, '%d %b %Y') END AS baseline_label,
           CASE WHEN end_date IS NULL THEN 'No current period available'
                ELSE 'Current period: ' || strftime(kpi_start, '%d %b %Y') || ' -> ' || strftime(end_date, '%d %b %Y') END AS kpi_label,
           CASE WHEN end_date IS NULL THEN 'No data'
                ELSE 'Global network | Report period ' || strftime(kpi_start, '%d %b %Y') || ' -> ' || strftime(end_date, '%d %b %Y') END AS scope_label
    FROM (SELECT *, CASE WHEN has AND b_end - 55 >= view_start THEN b_end - 55 ELSE view_start END AS b_start FROM (
            SELECT *, kpi_start - 1 AS b_end, kpi_start - 1 >= view_start AS has FROM pkb))
    """,
    "pkb",
)

cte("pscope_all", ("pkb",), SCOPE_SQL[SCOPE_SQL.index("SELECT CASE WHEN end_date IS NULL THEN 'unknown'"):])

KPIS_SQL = with_ctes(
    "SELECT passengers, vehicles, traffic_rows, active_corridors, round(congestion_raw, 1) AS congestion_index_pct, "
    "round(recent_7d, 1) AS recent_7d_avg_passengers, round(prior_7d, 1) AS prior_7d_avg_passengers, "
    "round(recent_30d, 1) AS recent_30d_avg_passengers, round(prior_30d, 1) AS prior_30d_avg_passengers FROM pk",
    "pk",
)

PY_VERSION_SQL = with_ctes(
    """
    SELECT CASE WHEN n = 0 THEN 'empty' ELSE CAST(mx AS VARCHAR) || '|rows:' || CAST(rws AS VARCHAR) || '|pax:' || CAST(pax AS VARCHAR)
                || '|top:' || substr(sha256(dg), 1, 16) END AS data_version
    FROM (SELECT COUNT(*) AS n, MAX(service_date) AS mx, CAST(COALESCE(SUM(rows_count), 0) AS BIGINT) AS rws,
                 CAST(COALESCE(SUM(total_passengers), 0) AS BIGINT) AS pax FROM pd_),
         (SELECT COALESCE(string_agg(departure_port || '->' || arrival_port || ':' || CAST(p AS VARCHAR), '|'
                   ORDER BY p DESC, departure_port, arrival_port), 'none') AS dg
          FROM (SELECT departure_port, arrival_port, SUM(total_passengers) AS p FROM pr_ GROUP BY ALL
                ORDER BY p DESC, departure_port, arrival_port LIMIT 5))
    """,
    "pd_", "pr_",
)


# ---- report card, snapshot table and friends ---------------------------------------------------------

def _compact(x: str) -> str:
    from portflow.plans.queries_analytics import _compact_sql

    return _compact_sql(x)


cte("pscope", ("pkb",),
    """SELECT CASE WHEN end_date IS NULL OR NOT has THEN 'No comparison baseline available'
                   ELSE strftime(b_start, '%d %b %Y') || ' -> ' || strftime(b_end, '%d %b %Y') END AS baseline_label,
              CAST(kpi_start AS VARCHAR) AS kpi_start, CAST(end_date AS VARCHAR) AS kpi_end,
              'Global network | Report period ' || strftime(kpi_start, '%d %b %Y') || ' -> ' || strftime(end_date, '%d %b %Y') AS scope_label
       FROM (SELECT *, CASE WHEN has AND b_end - 55 >= view_start THEN b_end - 55 ELSE view_start END AS b_start FROM (
               SELECT *, kpi_start - 1 AS b_end, kpi_start - 1 >= view_start AS has FROM pkb))""")

_OUTLOOK = """(CASE WHEN w.value_pct IS NULL THEN 'Hold the current view until another reporting window lands.'
      WHEN w.value_pct >= 8 THEN 'Expect demand to stay firm or edge higher in the next reporting window unless the spike reverses quickly.'
      WHEN w.value_pct <= -8 THEN 'Expect a soft patch in the next reporting window unless this week''s drop proves to be temporary.'
      ELSE 'Expect broadly stable movement in the next reporting window.' END)"""

cte(
    "preport",
    ("pk", "ptc", "ptp", "pprev", "pdelta", "psig", "pact", "pscope"),
    f"""
    SELECT 'Harbor Intelligence Report Card' AS title,
           'Current period: ' || {_compact('k.passengers')} || ' passengers and ' || {_compact('k.vehicles')}
             || ' vehicles. Congestion held at ' || printf('%.0f', round(k.congestion_raw, 1)) || '% of baseline.'
             || COALESCE(' ' || tc.pair_label || ' led with ' || printf('%.1f', tc.share_pct) || '% of traffic.', '')
             || COALESCE(' ' || tp.port_name || ' remained the busiest port.', '') AS summary,
           list_filter([
             'Comparison baseline: ' || sc.baseline_label || '.',
             'Traffic rows in the current period: ' || {_compact('k.traffic_rows')} || ' across ' || CAST(k.active_corridors AS VARCHAR) || ' active corridors.',
             'Top corridor ' || tc.pair_label || ' carried ' || {_compact('tc.passengers')} || ' passengers (' || printf('%.1f', tc.share_pct) || '% share).',
             'Top port ' || tp.port_name || ' handled ' || {_compact('tp.passengers')} || ' passengers.'], lambda x: x IS NOT NULL)[1:4] AS facts,
           CASE WHEN (SELECT COUNT(*) FROM psig WHERE severity IN ('watch', 'alert')) > 0
                THEN (SELECT list(summary ORDER BY ord) FROM psig WHERE severity IN ('watch', 'alert'))[1:3]
                ELSE COALESCE((SELECT list(summary ORDER BY ord) FROM psig)[1:1], []) END AS anomalies,
           COALESCE((SELECT list(summary ORDER BY ord) FROM pdelta)[1:3], []) AS comparisons,
           list_filter([(SELECT action FROM pact WHERE ord = 1), 'Outlook: ' || {_OUTLOOK}], lambda x: x IS NOT NULL)[1:3] AS recommendations,
           concat_ws(' ', w.summary, CASE WHEN mo.value_pct IS NOT NULL THEN mo.summary END,
                     CASE WHEN tc.pair_label IS NOT NULL AND pr.previous_top_corridor_label IS NOT NULL AND pr.previous_top_corridor_label <> ''
                          THEN CASE WHEN tc.pair_label = pr.previous_top_corridor_label
                                    THEN 'Route leadership remains anchored on ' || tc.pair_label || '.'
                                    ELSE 'Route leadership rotated from ' || pr.previous_top_corridor_label || ' to ' || tc.pair_label || '.' END END,
                     {_OUTLOOK}) AS report_text,
           COALESCE('Recommended action rationale: ' || (SELECT rationale FROM pact WHERE ord = 1),
                    'Recommended action rationale unavailable.') AS insight_text
    FROM pk k CROSS JOIN pscope sc CROSS JOIN pprev pr
    LEFT JOIN (SELECT * FROM ptc WHERE rank = 1) tc ON TRUE
    LEFT JOIN (SELECT * FROM ptp WHERE rank = 1) tp ON TRUE
    LEFT JOIN (SELECT * FROM pdelta WHERE name = 'passengers_7d_avg') w ON TRUE
    LEFT JOIN (SELECT * FROM pdelta WHERE name = 'passengers_30d_avg') mo ON TRUE
    """,
)

cte("pnotable", ("prk", "routes"), NOTABLE_SQL[NOTABLE_SQL.index("SELECT len(reasons)"):])
cte("pversion", ("pd_", "pr_"), PY_VERSION_SQL[PY_VERSION_SQL.index("SELECT CASE WHEN n = 0"):])

cte(
    "ppanel",
    ("preport", "pversion", "pnotable"),
    """
    SELECT TIMESTAMP '2026-01-03 00:05:00' AS snapshot_ts, 'agent_panel' AS chart_id, 'auto_panel' AS insight_type,
           'weekly' AS grain, CAST(NULL AS VARCHAR) AS filter_hash, (SELECT data_version FROM pversion) AS data_version,
           title, summary, facts, anomalies, comparisons, recommendations, report_text, insight_text,
           CASE WHEN (SELECT should_trigger FROM pnotable) THEN 'deterministic_no_api_key' ELSE 'deterministic_skip' END AS generation_mode
    FROM preport
    """,
)
_SNAP = ("snapshot_ts, chart_id, insight_type, data_version, filter_hash, title, summary, facts, anomalies, comparisons, "
         "recommendations, report_text, insight_text, generation_mode")
cte("snaptab", ("sdeep", "ppanel"), f"SELECT {_SNAP} FROM sdeep UNION ALL SELECT {_SNAP} FROM ppanel")

PANEL_SNAPSHOT_SQL = with_ctes(f"SELECT {_SNAP} FROM ppanel", "ppanel")


def writer_sql(end: str, lookbacks: list[int]) -> str:
    """Panel rows over windows of the day tables that end on ``end`` or on the newest day before it."""
    parts = []
    for days in lookbacks:
        window = (f"service_date BETWEEN (SELECT greatest(min(service_date), CAST(least(DATE '{end}', max(service_date)) - {days - 1} AS DATE)) "
                  f"FROM row_counts_daily) AND (SELECT least(DATE '{end}', max(service_date)) FROM row_counts_daily)")
        parts.append(with_ctes(f"SELECT {_SNAP} FROM ppanel", "ppanel", instead={
            "daily": (("row_counts_daily",), f"SELECT * FROM row_counts_daily WHERE {window}"),
            "routes": (("fct_route_daily", "row_counts_daily"),
                       "SELECT service_date, departure_port, arrival_port, traffic_record_count, total_passengers, "
                       f"CAST(0 AS BIGINT) AS total_vehicles FROM fct_route_daily WHERE {window}"),
            "ports": (("fct_port_daily", "row_counts_daily"), f"SELECT * FROM fct_port_daily WHERE {window}"),
        }))
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


LOOKUP_SQL = with_ctes(
    f"""SELECT {_SNAP} FROM snaptab WHERE chart_id = 'agent_panel' AND data_version = (SELECT data_version FROM pversion)
        AND (filter_hash = '0000000000000000' OR filter_hash IS NULL) AND insight_type = 'auto_panel'
        ORDER BY CASE WHEN filter_hash = '0000000000000000' THEN 0 WHEN filter_hash IS NULL THEN 1 ELSE 2 END, snapshot_ts DESC LIMIT 1""",
    "snaptab", "pversion",
)
LATEST_SQL = with_ctes(
    f"SELECT {_SNAP} FROM snaptab WHERE chart_id IN ('agent_panel', 'traffic_pulse', 'top_corridors', 'port_balance') "
    "QUALIFY row_number() OVER (PARTITION BY chart_id ORDER BY snapshot_ts DESC) = 1",
    "snaptab",
)
FRESHNESS_SQL = with_ctes(
    """SELECT probe, latest_snapshot_ts, hours_since_latest, latest_snapshot_ts IS NULL OR hours_since_latest > 48 AS is_stale FROM (
         SELECT p.probe, l.latest_snapshot_ts,
                CAST(epoch_us(p.now) - epoch_us(l.latest_snapshot_ts) AS DOUBLE) / 3.6e9 AS hours_since_latest
         FROM (VALUES ('1h', TIMESTAMP '2026-01-03 01:05:00'), ('48h', TIMESTAMP '2026-01-05 00:05:00'),
                      ('48.1h', TIMESTAMP '2026-01-05 00:11:00')) AS p(probe, now),
              (SELECT MAX(snapshot_ts) AS latest_snapshot_ts FROM snaptab WHERE chart_id = 'agent_panel' AND insight_type = 'auto_panel') l)""",
    "snaptab",
)


def _odistinct(expr: str) -> str:
    return f"list_filter({expr}, lambda x, i: x IS NOT NULL AND x <> '' AND list_position({expr}, x) = i)"


LINES_SQL = with_ctes(
    f"""
    SELECT chart_id, insight_type, data_version, snapshot_ts,
           CASE WHEN chart_id = 'agent_panel' AND insight_type = 'auto_panel' THEN
                {_odistinct("[trim(summary), CASE WHEN trim(report_text) <> trim(summary) THEN trim(report_text) END, "
                            "CASE WHEN recs[1] IS NOT NULL THEN CASE WHEN lower(recs[1]) LIKE 'action:%' THEN recs[1] ELSE 'Action: ' || recs[1] END END, recs[2]]")}
           ELSE {_odistinct("list_concat([trim(summary), CASE WHEN insight_type <> 'deepen_chart' THEN trim(report_text) END, trim(insight_text)], "
                            "list_transform(COALESCE(facts, []), lambda x: trim(x)), list_transform(COALESCE(anomalies, []), lambda x: trim(x)), "
                            "list_transform(COALESCE(comparisons, []), lambda x: trim(x)), list_transform(COALESCE(recommendations, []), lambda x: trim(x)))")}
           END AS lines,
           CASE WHEN chart_id = 'agent_panel' THEN (SELECT kpi_start FROM pscope) END AS kpi_start,
           CASE WHEN chart_id = 'agent_panel' THEN (SELECT kpi_end FROM pscope) END AS kpi_end,
           CASE WHEN chart_id = 'agent_panel' THEN (SELECT scope_label FROM pscope) END AS scope_label
    FROM (SELECT *, list_filter(list_transform(COALESCE(recommendations, []), lambda x: trim(x)), lambda x: x <> '') AS recs FROM snaptab)
    """,
    "snaptab", "pscope",
)
CACHE_SQL = with_ctes(
    """SELECT 'agent_panel' AS chart_id, (SELECT data_version FROM pversion) AS data_version,
              CAST(kpi_start AS DATE) = (SELECT MAX(service_date) - 6 FROM daily) AND CAST(kpi_end AS DATE) = (SELECT MAX(service_date) FROM daily)
              AS use_cached FROM pscope""",
    "pscope", "pversion", "daily",
)
PRESETS_SQL = with_ctes(
    """SELECT * FROM (
    WITH b AS (SELECT MIN(service_date) AS mn, MAX(service_date) AS mx, date_diff('day', MIN(service_date), MAX(service_date)) + 1 AS span FROM pd_),
    ps AS (SELECT ord, preset, lb AS lookback_days, least(lb, span) AS effective_days, mx - CAST(least(lb, span) - 1 AS INTEGER) AS start_date,
                  mx AS end_date FROM b, (VALUES (1, 'full', NULL), (2, 'year', 365), (3, '90', 90), (4, '30', 30), (5, '7', 7)) v(ord, preset, l0),
                  LATERAL (SELECT COALESCE(l0, greatest(span, 7)) AS lb))
    SELECT ps.ord, ps.preset, ps.lookback_days, ps.effective_days, ps.start_date, ps.end_date, d.day_rows,
           CAST(ps.end_date AS VARCHAR) || '|rows:' || CAST(d.rows_total AS VARCHAR) || '|pax:' || CAST(d.pax AS VARCHAR) || '|top:'
             || substr(sha256(COALESCE(g.digest, 'none')), 1, 16) AS data_version
    FROM ps
    JOIN (SELECT ps.ord, COUNT(*) AS day_rows, SUM(rows_count) AS rows_total, SUM(total_passengers) AS pax
          FROM ps JOIN pd_ ON pd_.service_date >= ps.start_date GROUP BY ps.ord) d ON d.ord = ps.ord
    LEFT JOIN (SELECT ord, string_agg(departure_port || '->' || arrival_port || ':' || CAST(p AS VARCHAR), '|' ORDER BY r) AS digest FROM (
                 SELECT ps.ord, departure_port, arrival_port, SUM(total_passengers) AS p,
                        row_number() OVER (PARTITION BY ps.ord ORDER BY SUM(total_passengers) DESC, departure_port, arrival_port) AS r
                 FROM ps JOIN pr_ ON pr_.service_date >= ps.start_date GROUP BY ps.ord, departure_port, arrival_port)
               WHERE r <= 5 GROUP BY ord) g ON g.ord = ps.ord)
    """,
    "pd_", "pr_",
)
FILTER_HASH_SQL = with_ctes(
    """SELECT corridor, substr(sha256('{"end":"' || CAST(b.mx AS VARCHAR) || '","grain":"weekly","port":"All ports","route":"' || corridor
              || '","start":"' || CAST(b.mn AS VARCHAR) || '","top_n":10}'), 1, 16) AS filter_hash
       FROM (SELECT DISTINCT departure_port || ' -> ' || arrival_port AS corridor FROM routes
             WHERE departure_port IS NOT NULL AND arrival_port IS NOT NULL),
            (SELECT MIN(service_date) AS mn, MAX(service_date) AS mx FROM daily) b""",
    "routes", "daily",
)

UPSERT_SQL = with_ctes(
    """SELECT TIMESTAMP '2026-01-04 00:05:00' AS snapshot_ts, chart_id, insight_type, data_version,
              filter_hash, title, generation_mode FROM snaptab
       UNION ALL
       SELECT TIMESTAMP '2026-01-05 00:05:00', 'agent_panel', 'auto_panel', (SELECT data_version FROM pversion) || '|kpi14',
              CAST(NULL AS VARCHAR), 'Harbor Intelligence Report Card',
              CASE WHEN (SELECT should_trigger FROM pnotable) THEN 'deterministic_no_api_key' ELSE 'deterministic_skip' END""",
    "snaptab", "pversion", "pnotable",
)


UPSERT_LOOKUP_SQL = with_ctes(
    """SELECT TIMESTAMP '2026-01-05 00:05:00' AS snapshot_ts, chart_id, insight_type, data_version, filter_hash, title, summary
       FROM snaptab WHERE chart_id = 'agent_panel'""",
    "snaptab",
)
TOUCHED_SQL = with_ctes(
    """SELECT COUNT(*) AS rows_count, CAST(1 AS BIGINT) AS changed_rows, CAST(1 AS INTEGER) AS rewritten_buckets, TRUE AS other_files_kept
       FROM (SELECT DISTINCT departure_port, arrival_port, date_trunc('month', service_date) FROM routes)""",
    "routes",
)
ANSWERS_SQL = with_ctes(
    f"""SELECT request_id, match, chart_id, insight_type, data_version, filter_hash, snapshot_ts, title FROM (
      SELECT r.request_id, CASE WHEN s.chart_id IS NULL THEN NULL WHEN s.data_version = r.v AND s.filter_hash = r.h THEN 'exact'
               WHEN s.data_version = r.v AND s.filter_hash IS NULL THEN 'unfiltered' ELSE 'latest' END AS match,
             s.chart_id, s.insight_type, s.data_version, s.filter_hash, s.snapshot_ts, s.title,
             row_number() OVER (PARTITION BY r.request_id ORDER BY CASE WHEN s.data_version = r.v AND s.filter_hash = r.h THEN 0
               WHEN s.data_version = r.v AND s.filter_hash IS NULL THEN 1 ELSE 2 END, s.snapshot_ts DESC, s.insight_type, s.data_version, s.filter_hash) AS n
      FROM (SELECT i AS request_id, c, k, CASE WHEN v = 'now' THEN (SELECT data_version FROM pversion) ELSE v END AS v, h FROM (VALUES
              (1, 'agent_panel', 'auto_panel', 'now', '00000000000000aa'), (2, 'agent_panel', 'auto_panel', 'now', '00000000000000bb'),
              (3, 'agent_panel', NULL, 'now', NULL), (4, 'agent_panel', 'auto_panel', 'older data', '00000000000000aa'),
              (5, 'agent_panel', 'auto_panel', 'no such data', '00000000000000aa'), (6, 'traffic_pulse', NULL, 'no such data', ''),
              (7, 'no_such_chart', 'auto_panel', 'now', '00000000000000aa'), (8, 'agent_panel', 'deepen_chart', 'now', '00000000000000aa')) t(i, c, k, v, h)) r
      LEFT JOIN (SELECT {_SNAP} FROM snaptab
                 UNION ALL SELECT * REPLACE ('00000000000000aa' AS filter_hash, 'filtered' AS title) FROM (SELECT {_SNAP} FROM snaptab WHERE chart_id = 'agent_panel')
                 UNION ALL SELECT * REPLACE ('older data' AS data_version, TIMESTAMP '2026-01-06 00:05:00' AS snapshot_ts, 'written later' AS title)
                           FROM (SELECT {_SNAP} FROM snaptab WHERE chart_id = 'agent_panel')) s
        ON s.chart_id = r.c AND (r.k IS NULL OR s.insight_type = r.k)) WHERE n = 1""",
    "snaptab", "pversion",
)
_NUMBER = "CAST(NULL AS DOUBLE)"
SOURCE_FIELDS_SQL = with_ctes(
    "SELECT part, CAST(ord AS INTEGER) AS ord, text, CAST(number AS DOUBLE) AS number FROM ("
    f"SELECT 'schema_version' AS part, 1 AS ord, 'auto_panel_source_v2' AS text, {_NUMBER} AS number "
    f"UNION ALL SELECT 'previous_top_corridor_label', 1, previous_top_corridor_label, {_NUMBER} FROM pprev "
    + "".join(f"UNION ALL SELECT 'scope.{c}', 1, {c}, {_NUMBER} FROM pscope_all " for c in
              ("baseline_start", "baseline_end", "kpi_start", "kpi_end", "baseline_label", "kpi_label", "scope_label"))
    + "".join(f"UNION ALL SELECT 'kpis.{c}', 1, NULL, {e} FROM pk " for c, e in {
        "passengers": "passengers", "vehicles": "vehicles", "traffic_rows": "traffic_rows", "active_corridors": "active_corridors",
        "congestion_index_pct": "round(congestion_raw, 1)", "recent_7d_avg_passengers": "round(recent_7d, 1)",
        "prior_7d_avg_passengers": "round(prior_7d, 1)", "recent_30d_avg_passengers": "round(recent_30d, 1)",
        "prior_30d_avg_passengers": "round(prior_30d, 1)"}.items())
    + "UNION ALL SELECT 'top_corridors', rank, pair_label || '|' || passengers || '|' || vehicles, share_pct FROM ptc "
    "UNION ALL SELECT 'top_ports', rank, port_name, passengers FROM ptp "
    "UNION ALL SELECT 'deltas', ord, concat_ws('|', name, label, period, direction, severity, summary), value_pct FROM pdelta "
    f"UNION ALL SELECT 'signals', ord, concat_ws('|', kind, severity, summary), {_NUMBER} FROM psig "
    f"UNION ALL SELECT 'action_candidates', ord, concat_ws('|', action, rationale, priority), {_NUMBER} FROM pact "
    f"UNION ALL SELECT 'notable_change_reasons', i, reasons[i], {_NUMBER} FROM (SELECT reasons, unnest(range(1, len(reasons) + 1)) AS i FROM pnotable))",
    "pprev", "pscope_all", "pk", "ptc", "ptp", "pdelta", "psig", "pact", "pnotable",
)


def _signed(x: str) -> str:
    return signed(x)


LIVE_SQL = with_ctes(
    f"""
    SELECT ord, paragraph FROM (
      SELECT unnest([p1, p2, p3, p4]) AS paragraph, unnest([1, 2, 3, 4]) AS ord FROM (
        SELECT
          'Current period: ' || strftime(cs, '%d %b %Y') || ' -> ' || strftime(ce, '%d %b %Y') || '. The network recorded '
            || {_compact('pax')} || ' passengers and ' || {_compact('veh')} || ' vehicles. The leading corridor is '
            || COALESCE(top_label, 'No data') || ' (' || printf('%.1f', share) || '% of scoped passengers), with '
            || COALESCE(top_port, 'No data') || ' as the highest-flow port. Congestion index is ' || printf('%.0f', cong)
            || '%. Comparison baseline: '
            || CASE WHEN bn >= 8 THEN CAST(bn AS VARCHAR) || ' x 7-day windows: ' || strftime(bs, '%d %b %Y') || ' -> ' || strftime(be, '%d %b %Y')
                    WHEN bn >= 1 THEN strftime(bs, '%d %b %Y') || ' -> ' || strftime(be, '%d %b %Y')
                    ELSE 'No comparison baseline available' END || '.' AS p1,
          'Notable shifts: '
            || CASE WHEN d7 IS NULL THEN 'Not enough history for 7-day change.' ELSE '7-day average passengers are ' || {_signed('d7')} || ' vs prior week.' END
            || ' ' || CASE WHEN d30 IS NULL THEN 'Not enough history for 30-day change.'
                           ELSE '30-day average passengers are ' || {_signed('d30')} || ' vs prior 30-day window.' END
            || ' ' || CASE WHEN recent_top IS NULL OR prior_top IS NULL THEN 'Route rank shift data unavailable.'
                           WHEN recent_top = prior_top THEN 'Top corridor remains ' || recent_top || ' across the last two weekly windows.'
                           ELSE 'Top corridor shifted from ' || prior_top || ' to ' || recent_top || ' in the latest week.' END AS p2,
          'Anomaly call-out: ' || CASE WHEN d7 IS NOT NULL AND abs(d7) >= 20
               THEN 'Traffic momentum moved ' || {_signed('d7')} || ' week-over-week, which is a notable swing. Likely causes include schedule shifts, route substitution, or reporting lag.'
               ELSE 'No high-severity anomaly flag triggered in the current scope.' END AS p3,
          'Outlook: ' || CASE WHEN d7 IS NULL THEN 'Direction is stable.'
                              WHEN d7 > 5 THEN 'Expect a mild upward drift over the next 7-14 days.'
                              WHEN d7 < -5 THEN 'Expect a mild downward normalization over the next 7-14 days.'
                              ELSE 'Expect relatively flat movement over the next 7-14 days.' END
            || ' This is a short operational directional signal based on recent window behavior; re-check after the next ingestion snapshot.' AS p4
        FROM (
          SELECT c.window_start AS cs, c.window_end AS ce, COALESCE(c.pax, 0) AS pax, COALESCE(c.veh, 0) AS veh,
                 b.bn, b.bs, b.be, tc.pair_label AS top_label,
                 CASE WHEN COALESCE(c.pax, 0) > 0 THEN CAST(COALESCE(tc.passengers, 0) AS DOUBLE) / CAST(c.pax AS DOUBLE) * 100.0 ELSE 0.0 END AS share,
                 tp.port_name AS top_port, COALESCE(cg.congestion_index, 0.0) AS cong,
                 CASE WHEN t.n >= 14 AND t.p7 > 0 THEN (t.r7 - t.p7) / t.p7 * 100.0 END AS d7,
                 CASE WHEN t.n >= 60 AND t.p30 > 0 THEN (t.r30 - t.p30) / t.p30 * 100.0 END AS d30,
                 sh.recent_top, sh.prior_top
          FROM (SELECT * FROM wmet WHERE window_index = 0) c
          CROSS JOIN (SELECT COUNT(*) AS bn, MIN(window_start) AS bs, MAX(window_end) AS be FROM wmet WHERE window_index >= 1) b
          LEFT JOIN (SELECT * FROM (
                       SELECT departure_port || ' -> ' || arrival_port AS pair_label, SUM(total_passengers) AS passengers, SUM(total_vehicles) AS vehicles
                       FROM rv, wp WHERE rv.service_date BETWEEN wp.cur_start AND wp.cur_end AND departure_port IS NOT NULL AND arrival_port IS NOT NULL
                       GROUP BY departure_port, arrival_port) ORDER BY passengers DESC, vehicles DESC, pair_label LIMIT 1) tc ON TRUE
          LEFT JOIN (SELECT port_name FROM (
                       SELECT port_name, SUM(total_departing_passengers) AS d, SUM(total_arriving_passengers) AS a FROM pv, wp
                       WHERE pv.service_date BETWEEN wp.cur_start AND wp.cur_end GROUP BY port_name)
                     ORDER BY d DESC, a DESC, port_name NULLS FIRST LIMIT 1) tp ON TRUE
          CROSS JOIN (SELECT least(CASE WHEN pk2 != 0 THEN r7 / pk2 * 100.0 ELSE 0.0 END, 100.0) AS congestion_index FROM (
                        SELECT COALESCE(AVG(CASE WHEN rn <= 7 THEN CAST(rows_count AS DOUBLE) END), 0.0) AS r7,
                               COALESCE(quantile_cont(CAST(rows_count AS DOUBLE), 0.95), 0.0) AS pk2
                        FROM (SELECT rows_count, row_number() OVER (ORDER BY service_date DESC) AS rn FROM dv))) cg
          CROSS JOIN (SELECT COUNT(*) AS n, AVG(CASE WHEN rn <= 7 THEN CAST(total_passengers AS DOUBLE) END) AS r7,
                             AVG(CASE WHEN rn BETWEEN 8 AND 14 THEN CAST(total_passengers AS DOUBLE) END) AS p7,
                             AVG(CASE WHEN rn <= 30 THEN CAST(total_passengers AS DOUBLE) END) AS r30,
                             AVG(CASE WHEN rn BETWEEN 31 AND 60 THEN CAST(total_passengers AS DOUBLE) END) AS p30
                      FROM (SELECT COALESCE(total_passengers, 0) AS total_passengers, row_number() OVER (ORDER BY service_date DESC) AS rn
                            FROM dv WHERE service_date IS NOT NULL)) t
          CROSS JOIN (SELECT
              (SELECT departure_port || ' -> ' || arrival_port FROM (
                 SELECT departure_port, arrival_port, SUM(total_passengers) AS p FROM rv, (SELECT MAX(service_date) AS mx FROM rv) m
                 WHERE departure_port IS NOT NULL AND arrival_port IS NOT NULL AND service_date BETWEEN mx - 6 AND mx GROUP BY ALL
                 ORDER BY p DESC, departure_port, arrival_port LIMIT 1)) AS recent_top,
              (SELECT departure_port || ' -> ' || arrival_port FROM (
                 SELECT departure_port, arrival_port, SUM(total_passengers) AS p FROM rv, (SELECT MAX(service_date) AS mx FROM rv) m
                 WHERE departure_port IS NOT NULL AND arrival_port IS NOT NULL AND service_date BETWEEN mx - 13 AND mx - 7 GROUP BY ALL
                 ORDER BY p DESC, departure_port, arrival_port LIMIT 1)) AS prior_top) sh
        )))
    """,
    "wmet", "wp", "rv", "pv", "dv",
)
