"""Panel and analytics rules on small hand-made day-grain frames (thresholds, empty input, zero division)."""

import datetime as dt

from pyspark.sql import functions as F

from portflow.operators import analytics as N
from portflow.operators import panel as P

D0 = dt.date(2024, 1, 1)
DAILY = "service_date date, rows_count long, total_passengers long, total_vehicles long, distinct_route_pairs long"
ROUTES = "service_date date, departure_port string, arrival_port string, traffic_record_count long, total_passengers long, total_vehicles long"
PORTS = ("service_date date, port_name string, departure_record_count long, arrival_record_count long, "
         "total_departing_passengers long, total_arriving_passengers long, total_departing_vehicles long, total_arriving_vehicles long")


def daily(spark, pax, start=D0, step=1):
    rows = [(start + dt.timedelta(days=i * step), 10, p, 1, 1) for i, p in enumerate(pax)]
    return spark.createDataFrame(rows, DAILY)


def routes_with_share(spark, share_pct):
    # 4 × share on the top corridor and (100 − share) on each of four others: total 400.
    rows = [(D0, "A", "B", 1, 4 * share_pct, 0)]
    rows += [(D0, f"X{i}", "Y", 1, 100 - share_pct, 0) for i in range(4)]
    return spark.createDataFrame(rows, ROUTES)


def test_concentration_severity_boundaries(spark):
    expected = {29: "info", 30: "watch", 45: "alert", 100: "alert"}
    for share, sev in expected.items():
        r = routes_with_share(spark, share)
        d = daily(spark, [400])  # the share is taken of the daily passenger total
        p = spark.createDataFrame([], PORTS)
        ctx = P.panel_context(d, r, p, 7)
        sig = {x.kind: x.severity for x in P.panel_signals(ctx).collect()}
        assert sig["corridor_concentration"] == sev, (share, sig)


def test_notable_change_rules(spark):
    # 7 prior days at 1000, 7 recent at 1200: +20 % and recent ≥ 1000 → fires.
    d = daily(spark, [1000] * 7 + [1200] * 7)
    r = routes_with_share(spark, 10)
    out = P.notable_change(d, r).first()
    assert out.should_trigger and out.reasons == ["7-day passenger average changed +20.0% vs prior week"]
    # Below the passenger floor: no trigger.
    d2 = daily(spark, [100] * 7 + [120] * 7)
    assert not P.notable_change(d2, r).first().should_trigger
    # Concentration ≥ 45 % fires the second rule.
    out3 = P.notable_change(daily(spark, [5]), routes_with_share(spark, 45)).first()
    assert out3.reasons == ["Top corridor concentration reached 45.0%"]


def test_delta_direction_and_severity(spark):
    cases = {-20: ("down", "alert"), -5: ("down", "info"), -1: ("flat", "info"), 0: ("flat", "info"),
             1: ("flat", "info"), 5: ("up", "info"), 10: ("up", "watch"), 20: ("up", "alert")}
    for pct, (direction, severity) in cases.items():
        d = daily(spark, [1000] * 7 + [1000 + 10 * pct] * 7)
        ctx = P.panel_context(d, routes_with_share(spark, 10), spark.createDataFrame([], PORTS), 7)
        first = P.panel_deltas(ctx).where(F.col("name") == "passengers_7d_avg").first()
        assert (first.direction, first.severity) == (direction, severity), pct


def test_history_length_decides_which_averages_exist(spark):
    for n, (p7, r30, p30) in {6: (False, False, False), 13: (False, False, False), 14: (True, False, False),
                              29: (True, False, False), 30: (True, True, False), 59: (True, True, False),
                              60: (True, True, True)}.items():
        k = P.panel_kpis(daily(spark, [100] * n), spark.createDataFrame([], ROUTES), 7).first()
        got = (k.prior_7d_avg_passengers is not None, k.recent_30d_avg_passengers is not None,
               k.prior_30d_avg_passengers is not None)
        assert got == (p7, r30, p30), n


def test_row_windows_differ_from_calendar_windows(spark):
    # 14 day rows spread over ~30 calendar days (every other day): the 7-row mean spans 13 days.
    d = daily(spark, list(range(1, 15)), step=2)
    k = P.panel_kpis(d, spark.createDataFrame([], ROUTES), 7).first()
    assert k.recent_7d_avg_passengers == 11.0  # rows 8..14 → values 8..14
    assert k.passengers == 14 + 13 + 12 + 11  # calendar KPI window: last 7 days hold 4 rows (days 20..26)


def test_empty_input(spark):
    d = spark.createDataFrame([], DAILY)
    r = spark.createDataFrame([], ROUTES)
    p = spark.createDataFrame([], PORTS)
    ctx = P.panel_context(d, r, p, 7)
    acts = P.panel_actions(ctx).collect()
    assert [a.priority for a in acts] == ["escalate"]
    assert P.py_data_version(d, r).first().data_version == "empty"
    assert P.panel_scope(d).first().kpi_label == "No current period available"


def test_kpi_delta_zero_baseline_is_flat(spark):
    d = daily(spark, [0] * 70 + [5] * 7)
    r = spark.createDataFrame([(D0 + dt.timedelta(days=i), "A", "B", 1, 0, 0) for i in range(77)], ROUTES)
    p = spark.createDataFrame([], PORTS)
    view = N.full_view(d)
    deltas = {x.metric: x for x in N.kpi_deltas(N.window_metrics(d, r, p, view)).collect()}
    assert deltas["pax"].direction == "flat" and deltas["pax"].delta_label == "0.0% vs Avg"


def test_freshness_boundaries(spark):
    ts = dt.datetime(2026, 1, 1, 0, 0)
    snaps = spark.createDataFrame([(ts, "agent_panel", "auto_panel")], "snapshot_ts timestamp_ntz, chart_id string, insight_type string")
    def stale(hours):
        now = F.lit(ts + dt.timedelta(hours=hours)).cast("timestamp_ntz")
        return P.snapshot_freshness(snaps, now).first().is_stale
    assert not stale(48.0) and stale(48.1)
    empty = snaps.where(F.lit(False))
    assert P.snapshot_freshness(empty, F.lit(ts).cast("timestamp_ntz")).first().is_stale


def test_source_document_agrees_with_checked_parts(spark):
    """The JSON source document carries the same values as the oracle-checked panel queries."""
    import json

    from portflow.plans.models import TrafficModels
    from tests.conftest import SF_SMALL

    m = TrafficModels(spark, SF_SMALL).materialize()
    ctx = P.panel_context(m.daily, m.routes, m.ports, 7)
    doc = json.loads(P.panel_source_json(ctx).first().source_snapshot_json)
    kpis = P.panel_kpis(m.daily, m.routes, 7).first().asDict()
    assert doc["schema_version"] == "auto_panel_source_v2"
    assert doc["kpis"] == kpis
    assert [d["summary"] for d in doc["deltas"]] == [r.summary for r in P.panel_deltas(ctx).orderBy("ord").collect()]
    assert len(doc["top_corridors"]) <= 5 and len(doc["signals"]) <= 8 and len(doc["action_candidates"]) <= 4
    assert doc["scope"]["kpi_end"] == m.daily.agg(F.max("service_date")).first()[0].isoformat()
