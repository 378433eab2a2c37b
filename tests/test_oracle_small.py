"""A subset of the registered queries (one or more of each group) against their DuckDB oracles on the smallest testdata."""

import datetime as dt
import hashlib
import json
import math

import duckdb
import pytest

import __spark_entry__ as E
from portflow.plans import registry
from portflow.sources.testdata import TABLES
from tests.conftest import SF_SMALL


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return v


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(json.dumps([norm(r[i]) for i in order], default=str) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


FAST = ["stg_clean", "int_traffic_record", "row_counts_weekly", "fct_route_monthly", "dim_route", "dq_int_traffic_record",
        "dq_custom", "top_routes_pax", "explore_routes", "port_netflow", "netflow_reconcile", "window_kpis", "kpi_deltas",
        "concentration_monthly", "weekday_profile", "snap_deepen_rows", "snap_route_digest", "notable_change", "panel_signals",
        "panel_actions", "plan_windows", "audit_windows", "fmt_compact", "ingest_extract_records", "ingest_raw_rows",
        "ingest_quarantine", "dq_landed_casts", "snapshot_upsert", "upsert_then_lookup", "snapshot_lines", "filter_hash", "load_weekly",
        "snapshot_answers", "upsert_touched_buckets", "panel_source_fields", "panel_writer", "load_audit", "scope_corridor",
        "scope_corridor_and_port", "concentration_grains", "refresh_token_stored", "route_weekly_from_buckets"]


@pytest.mark.parametrize("key", FAST)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert digest(df.columns, srows) == digest(ocols, orows)


def test_every_query_has_a_builder_and_most_have_oracles():
    assert set(E.oracle_sql()) <= set(E.queries())
    own, os_ = registry.QUERIES, registry.ORACLE
    assert set(own) - set(os_) <= {"panel_source_json"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "rows_count" in df.columns
