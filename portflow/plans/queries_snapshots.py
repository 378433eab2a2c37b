"""Registered snapshot-model queries (SNP1–SNP10)."""

from __future__ import annotations

import re

from portflow.operators import snapshots as S
from portflow.plans.models import TrafficModels
from portflow.plans.oracle_base import cte, with_ctes
from portflow.plans.registry import register

# The oracle works from the records of the scope, not from the model's tables: every figure is an aggregate over
# ``snap_records`` of its own.
cte("snap_records", ("rec",),
    """SELECT r.*, ifnull(departure_port, 'Unknown') || ' -> ' || ifnull(arrival_port, 'Unknown') AS corridor,
              newest AS last_day, greatest(oldest, CAST(newest - 89 AS DATE)) AS first_day
       FROM rec r, (SELECT min(service_date) AS oldest, max(service_date) AS newest FROM rec)
       WHERE service_date > newest - 90""")
cte("snap_days", ("snap_records",),
    "SELECT service_date, count(*) AS rows_count, CAST(ifnull(sum(passenger_count), 0) AS BIGINT) AS total_passengers, "
    "CAST(ifnull(sum(vehicle_count), 0) AS BIGINT) AS total_vehicles FROM snap_records GROUP BY service_date")
cte("snap_labels", ("snap_records",),
    "SELECT corridor AS pair_label, CAST(ifnull(sum(passenger_count), 0) AS BIGINT) AS passengers, count(*) AS sailings "
    "FROM snap_records GROUP BY corridor")

_SCOPE = "SELECT any_value(first_day) AS start_date, any_value(last_day) AS end_date FROM snap_records"
_TOTALS = (
    "SELECT any_value(first_day) AS start_date, any_value(last_day) AS end_date, count(*) AS rows_total, "
    "CAST(ifnull(sum(passenger_count), 0) AS BIGINT) AS passengers_total, CAST(ifnull(sum(vehicle_count), 0) AS BIGINT) AS vehicles_total "
    "FROM snap_records"
)
# newest day first; a slice beyond the list is empty and has no mean
_TREND = (
    "SELECT ifnull(list_avg(days[1:7]), 0.0) AS recent_avg_passengers, ifnull(list_avg(days[8:14]), 0.0) AS prior_avg_passengers "
    "FROM (SELECT list(CAST(total_passengers AS DOUBLE) ORDER BY service_date DESC) AS days FROM snap_days)"
)
_TOP_CORRIDOR = "SELECT pair_label, passengers, sailings FROM snap_labels QUALIFY rank() OVER (ORDER BY passengers DESC, sailings DESC, pair_label) = 1"
_DIGEST = (
    "SELECT CASE WHEN len(parts) = 0 THEN 'none' ELSE left(sha256(array_to_string(parts, '|')), 16) END AS top_routes_hash FROM "
    "(SELECT ifnull(list(format('{}:{}', pair_label, passengers) ORDER BY passengers DESC, pair_label), [])[1:5] AS parts FROM snap_labels)"
)
_TOP_PORT = (
    "SELECT port_name, passengers FROM (SELECT port_name, CAST(ifnull(sum(passenger_count), 0) AS BIGINT) AS passengers FROM "
    "(SELECT unnest([departure_port, arrival_port]) AS port_name, passenger_count FROM snap_records) WHERE port_name IS NOT NULL GROUP BY port_name) "
    "QUALIFY rank() OVER (ORDER BY passengers DESC, port_name) = 1"
)
_BASE = f"""
    SELECT total.*, trend.*,
           ifnull(corridor.pair_label, 'No data') AS top_corridor_label, CAST(ifnull(corridor.passengers, 0) AS BIGINT) AS top_corridor_passengers,
           CAST(ifnull(corridor.sailings, 0) AS BIGINT) AS top_corridor_sailings,
           ifnull(port.port_name, 'No data') AS top_port_name, CAST(ifnull(port.passengers, 0) AS BIGINT) AS top_port_passengers,
           format('{{}}|rows:{{}}|pax:{{}}|top:{{}}', CAST(end_date AS VARCHAR), rows_total, passengers_total, top_routes_hash) AS data_version
    FROM ({_TOTALS}) total POSITIONAL JOIN ({_TREND}) trend POSITIONAL JOIN ({_DIGEST}) digest
         POSITIONAL JOIN ({_TOP_CORRIDOR}) corridor POSITIONAL JOIN ({_TOP_PORT}) port
"""
cte("sbase", ("snap_records", "snap_days", "snap_labels"), _BASE)

# The sentences of the three rows. Braces name a figure of ``_FIGURES``; lists become arrays.
_SENTENCES = [
    {
        "chart_id": "traffic_pulse", "title": "Traffic Pulse Insight",
        "summary": "Recent 7-day passenger average is {recent} versus prior {prior}, indicating {direction} momentum.",
        "facts": ["Recent 7-day average: {recent} passengers/day.", "Prior 7-day average: {prior} passengers/day."],
        "anomalies": ["{change}"],
        "comparisons": ["Window total passengers: {passengers}.", "Window total vehicles: {vehicles}."],
        "recommendations": ["Investigate major day-over-day swings against route concentration changes."],
        "report_text": "Trend check: recent 7-day average {recent} vs prior {prior}.",
    },
    {
        "chart_id": "top_corridors", "title": "Top Corridors Insight",
        "summary": "Leading corridor is {corridor} with {corridor_passengers} passengers and {sailings} sailings in scope.",
        "facts": ["Top corridor: {corridor}.", "Top corridor passengers: {corridor_passengers}.", "Top corridor sailings: {sailings}."],
        "anomalies": ["Top corridor share: {corridor_share}% of total passengers."],
        "comparisons": ["Total window passengers: {passengers}."],
        "recommendations": ["Watch for concentration spikes that increase network dependency on one corridor."],
        "report_text": "Corridor concentration summary: {corridor} leads with {corridor_passengers} passengers.",
    },
    {
        "chart_id": "port_balance", "title": "Port Balance Insight",
        "summary": "Highest passenger flow port is {port} with {port_passengers} passengers in the current window.",
        "facts": ["Top port: {port}.", "Top port passengers: {port_passengers}."],
        "anomalies": ["Top port share of total passengers: {port_share}%."],
        "comparisons": ["Total portscope passengers in window: {passengers}."],
        "recommendations": ["Review weekday imbalance at the leading port and monitor abrupt inflow/outflow changes."],
        "report_text": "Port focus summary: {port} leads at {port_passengers} passengers.",
    },
]
_whole = "CAST(CAST(round({}) AS BIGINT) AS VARCHAR)".format
_percent = "printf('%.1f', CASE WHEN passengers_total > 0 THEN 100.0 * ({0} / CAST(passengers_total AS DOUBLE)) ELSE 0.0 END)".format
_change = "((recent_avg_passengers - prior_avg_passengers) / prior_avg_passengers * 100.0)"
_FIGURES = {
    "recent": _whole("recent_avg_passengers"), "prior": _whole("prior_avg_passengers"),
    "passengers": "CAST(passengers_total AS VARCHAR)", "vehicles": "CAST(vehicles_total AS VARCHAR)",
    "corridor": "top_corridor_label", "corridor_passengers": "CAST(top_corridor_passengers AS VARCHAR)", "sailings": "CAST(top_corridor_sailings AS VARCHAR)",
    "port": "top_port_name", "port_passengers": "CAST(top_port_passengers AS VARCHAR)",
    "corridor_share": _percent("top_corridor_passengers"), "port_share": _percent("top_port_passengers"),
    "direction": "if(recent_avg_passengers < prior_avg_passengers, 'downward', 'upward')",
    "change": "if(prior_avg_passengers > 0, 'Delta vs prior 7-day window: ' || if(signbit(" + _change + "), '', '+') "
              "|| printf('%.1f', " + _change + ") || '%.', 'Insufficient prior window for delta.')",
}


def _sentence(value) -> str:
    """A sentence (or a list of them) as SQL: its literal parts and figures, concatenated."""
    if isinstance(value, list):
        return f"[{', '.join(map(_sentence, value))}]"
    parts = re.split(r"\{(\w+)\}", value)
    sql = [_FIGURES[x] if i % 2 else f"'{x}'" for i, x in enumerate(parts) if i % 2 or x]
    return " || ".join(sql)


_EMPTY = ("filter_hash", "insight_text", "generation_error", "model_name", "source_snapshot_json", "overlay_json")
_SAME = {"snapshot_ts": "TIMESTAMP '2026-01-03 00:00:00'", "insight_type": "'deepen_chart'", "grain": "'weekly'", "generation_mode": "'deterministic_sql'"}


def _rows() -> str:
    rows = []
    for row in _SENTENCES:
        cols = _SAME | {k: _sentence(v) for k, v in row.items()} | dict.fromkeys(_EMPTY, "CAST(NULL AS VARCHAR)")
        rows.append(f"SELECT data_version, {', '.join(f'{v} AS {k}' for k, v in cols.items())} FROM sbase")
    order = "snapshot_ts, chart_id, insight_type, grain, filter_hash, data_version, title, summary, facts, anomalies, comparisons, " \
            "recommendations, report_text, insight_text, generation_mode, generation_error, model_name, source_snapshot_json, overlay_json"
    return f"SELECT {order} FROM ({' UNION ALL BY NAME '.join(rows)})"


cte("sdeep", ("sbase",), _rows())


MONTH = "service_month_start"  # the stored route-day grain is partitioned by it


def _m(spark, sf_dir):
    # The model's one-row parts are scalar subqueries over the day grain:
    # store the day grain once so each subquery reads a small table.
    return TrafficModels(spark, sf_dir).materialize()


def _scoped(spark, sf_dir):
    m = _m(spark, sf_dir)
    scope = S.scope_bounds(m.daily)
    return m, scope


@register("snap_scope", with_ctes(_SCOPE, "snap_records"))
def q_snap_scope(spark, sf_dir):
    return S.snap_scope(_m(spark, sf_dir).daily)


@register("snap_daily_scope", with_ctes("SELECT * FROM snap_days", "snap_days"))
def q_snap_daily_scope(spark, sf_dir):
    m, scope = _scoped(spark, sf_dir)
    return S.in_scope(m.daily, scope).select("service_date", "rows_count", "total_passengers", "total_vehicles")


@register("snap_totals", with_ctes(_TOTALS, "snap_records"))
def q_snap_totals(spark, sf_dir):
    m, scope = _scoped(spark, sf_dir)
    return S.snap_totals(S.in_scope(m.daily, scope), scope)


@register("snap_trend", with_ctes(_TREND, "snap_days"))
def q_snap_trend(spark, sf_dir):
    m, scope = _scoped(spark, sf_dir)
    return S.snap_trend(S.in_scope(m.daily, scope))


@register("snap_corridors", with_ctes("SELECT * FROM snap_labels", "snap_labels"))
def q_snap_corridors(spark, sf_dir):
    m, scope = _scoped(spark, sf_dir)
    return S.snap_corridors(S.in_scope(m.route_day, scope, month_col=MONTH))


@register("snap_top_corridor", with_ctes(_TOP_CORRIDOR, "snap_labels"))
def q_snap_top_corridor(spark, sf_dir):
    m, scope = _scoped(spark, sf_dir)
    return S.snap_top_corridor(S.snap_corridors(S.in_scope(m.route_day, scope, month_col=MONTH)))


@register("snap_route_digest", with_ctes(_DIGEST, "snap_labels"))
def q_snap_route_digest(spark, sf_dir):
    m, scope = _scoped(spark, sf_dir)
    return S.snap_route_digest(S.snap_corridors(S.in_scope(m.route_day, scope, month_col=MONTH)))


@register("snap_top_port", with_ctes(_TOP_PORT, "snap_records"))
def q_snap_top_port(spark, sf_dir):
    m, scope = _scoped(spark, sf_dir)
    return S.snap_top_port(S.in_scope(m.fct_port_daily, scope))


@register("snap_data_version", with_ctes("SELECT * FROM sbase", "sbase"))
def q_snap_data_version(spark, sf_dir):
    m = _m(spark, sf_dir)
    return S.snap_base(m.daily, m.route_day, m.fct_port_daily, MONTH)


@register("snap_deepen_rows", with_ctes("SELECT * FROM sdeep", "sdeep"))
def q_snap_deepen_rows(spark, sf_dir):
    m = _m(spark, sf_dir)
    return S.intelligence_snapshots(m.daily, m.route_day, m.fct_port_daily, month_col=MONTH)
