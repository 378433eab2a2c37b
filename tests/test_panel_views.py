"""Nested views in one pass: equal to one view at a time, scans that don't grow with the lookbacks, months pruned."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from portflow.operators import panel as P
from portflow.operators.panel_views import PanelViews
from portflow.plans.models import TrafficModels
from tests.conftest import SF_SMALL
from tests.test_panel_rules import DAILY, PORTS, ROUTES
from tests.test_plans import plan


def frames(spark, days, seed=1, gap=0.1):
    g = random.Random(seed)
    dates = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(days) if g.random() > gap]
    names = ["A", "B", "C", "Unknown", None]
    routes = [(d, g.choice(names), g.choice(names), 1, g.randrange(2000), g.randrange(50)) for d in dates for _ in range(g.randrange(1, 6))]
    ports = [(d, g.choice(names), 1, 1, g.randrange(900), g.randrange(900), 0, 0) for d in dates for _ in range(3)]
    daily = [(d, sum(r[0] == d for r in routes), sum(r[4] for r in routes if r[0] == d), sum(r[5] for r in routes if r[0] == d), 1) for d in dates]
    return spark.createDataFrame(daily, DAILY), spark.createDataFrame(routes, ROUTES), spark.createDataFrame(ports, PORTS)


@pytest.mark.parametrize(("days", "end"), [(100, "2024-03-01"), (9, None)])
def test_views_equal_one_view_at_a_time(spark, days, end):
    daily, routes, ports = frames(spark, days)
    lookbacks = ["7", "full", "30"]
    drop = ("ord", "lookback")
    together = {r.lookback: r.asDict(True) for r in P.panel_contexts(PanelViews(daily, lookbacks, end), routes, ports).collect()}
    assert set(together) == set(lookbacks)
    b = daily.agg(F.min("service_date").alias("a"), F.max("service_date").alias("z")).first()
    last = min(b.z, dt.date.fromisoformat(end)) if end else b.z
    for token in lookbacks:
        span = (last - b.a).days + 1
        n = min(max(span, 7) if token == "full" else int(token), span)
        cut = [df.where(F.col("service_date").between(last - dt.timedelta(days=n - 1), last)) for df in (daily, routes, ports)]
        alone = P.panel_context(*cut).first().asDict(True)
        assert {k: v for k, v in together[token].items() if k not in drop} == {k: v for k, v in alone.items() if k not in drop}, token
        assert alone["data_version"] == P.py_data_version(cut[0], cut[1]).first().data_version
        notable = P.notable_change(cut[0], cut[1]).first()
        assert (alone["should_trigger"], alone["notable_change_reasons"]) == (notable.should_trigger, notable.reasons)


def test_scans_do_not_grow_with_lookbacks(spark):
    m = TrafficModels(spark, SF_SMALL).materialize()

    def scans(lookbacks):
        return plan(P.panel_rows(m.daily, m.routes_by_month, m.ports, lookbacks)).count("Scan parquet")

    assert scans(["90"]) == scans(["90", "30", "60", "365", "full"])


def test_subqueries_are_the_bounds_only(spark):
    m = TrafficModels(spark, SF_SMALL).materialize()
    tree = P.panel_context(m.daily, m.routes_by_month, m.ports)._jdf.queryExecution().optimizedPlan()
    kinds, todo = set(), [tree]
    while todo:
        node = todo.pop()
        subs = node.subqueries()
        kinds |= {subs.apply(i).canonicalized().toString() for i in range(subs.size())}
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert len(kinds) == 1 and "min(" in next(iter(kinds))  # one: the bounds of the days


@pytest.mark.parametrize("key", ["window_kpis", "panel_top_corridors", "panel_prev_top", "panel_kpis", "panel_writer", "top_corridors_kpi"])
def test_corridors_are_read_by_month(spark, key):
    assert "PartitionFilters: [isnotnull(service_month_start" in plan(E.queries()[key](spark, SF_SMALL)), key


def test_answers_rank_version_then_latest(spark):
    ts = lambda h: dt.datetime(2026, 1, 1, h)
    snaps = spark.createDataFrame(
        [(ts(1), "c", "k", "v1", None, "bare"), (ts(0), "c", "k", "v1", "h", "hashed"), (ts(5), "c", "x", "v2", "z", "newest"),
         (ts(2), "c", "k", "v1", "h2", "other hash"), (ts(3), "c", "k", "", "", "empty names")] + [(ts(4), "hot", "k", f"v{i}", None, "h") for i in range(300)],
        "snapshot_ts timestamp_ntz, chart_id string, insight_type string, data_version string, filter_hash string, title string")
    asks = [(1, "c", "k", "v1", "h", "exact", "hashed"), (2, "c", "k", "v1", "nope", "unfiltered", "bare"), (3, "c", "k", "v1", None, "unfiltered", "bare"),
            (4, "c", "k", "v2", "z", "latest", "empty names"), (5, "c", None, "v2", "z", "exact", "newest"), (6, "c", None, None, None, "latest", "newest"),
            (7, "c", "k", "", "", "exact", "empty names"), (8, "none", None, "v1", "h", None, None), (9, "hot", "k", "v7", "q", "unfiltered", "h")]
    requests = spark.createDataFrame([a[:5] for a in asks], "request_id int, chart_id string, insight_type string, data_version string, filter_hash string")
    got = {r.request_id: (r.match, r.title) for r in P.snapshot_answers(snaps, requests).collect()}
    assert got == {a[0]: a[5:] for a in asks}
    assert P.snapshot_answers(snaps.limit(0), requests).where("match is null").count() == len(asks)
    assert P.snapshot_answers(snaps, requests.limit(0)).count() == 0
