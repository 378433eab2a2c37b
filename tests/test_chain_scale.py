"""The chain at scale: what travels through its shuffles, how often it runs, and that its narrow form gives the same rows."""

import datetime as dt

import pytest

import __spark_entry__ as E
from portflow.operators import quality as Q
from portflow.operators import records as R
from portflow.operators import rollups as U
from portflow.operators.staging import stg_clean
from portflow.plans.models import TrafficModels
from portflow.sources import testdata
from tests.conftest import SF_SMALL
from tests.test_staging_edges import T1, raw


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """A star schema of its own: 40 orders of 2 lines over 3 parts, one without a name, and a customer of no nation."""
    d = str(tmp_path_factory.mktemp("star"))
    spark.createDataFrame([(0, "GREECE"), (1, "ITALY")], "n_nationkey int, n_name string").write.parquet(f"{d}/nation.parquet")
    spark.createDataFrame([(0, 0), (1, 1), (2, 9)], "c_custkey long, c_nationkey int").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(0, 1), (1, 0)], "s_suppkey long, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame(
        [(0, "a", "Brand#1", "T1", 3), (1, None, "Brand#2", "T2", 4), (2, "c", None, "T3", 5)],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{d}/part.parquet")
    days = [dt.datetime(2024, 3, 1 + i % 5) for i in range(40)]
    spark.createDataFrame([(i, i % 3, days[i]) for i in range(40)], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(
        [(i // 2, i % 3, i % 2, 1 + i % 2, float(i % 4)) for i in range(80)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    return d


def rows(df):
    return sorted(map(str, df.collect()))


def test_route_day_is_the_same_by_its_base_columns(spark):
    """A name given by the ports and the same name spelt out share a row only if they share the keys."""
    df = raw(spark, [
        dict(record_hash="a", route_code=None, route_name=None, passenger_count="5"),
        dict(record_hash="b", route_code=None, route_name="PIRAEUS -> NAXOS", passenger_count="7"),
        dict(record_hash="c", route_name=None, passenger_count="x"),
        dict(record_hash="d", route_name="PIRAEUS -> NAXOS", vehicle_count=None),
        dict(record_hash="e", route_code=None, route_name=None, departure_port=None, raw_payload='{"route": "From payload"}'),
        dict(record_hash="f", route_code=None, route_name=None, departure_port=None),
        dict(record_hash="d", route_name="older", ingested_at=dt.datetime(2025, 1, 1)),
        dict(record_hash="g", ingested_at=T1, raw_payload="{}"),
        dict(record_hash="g", ingested_at=T1, raw_payload='{"x": 1}', route_code="larger payload"),
    ])
    rec = R.int_traffic_record(stg_clean(df))
    want = U.int_route_day(rec)
    got = U.route_day_rows(U.route_day_sums(R.clean_from_raw(df)))
    assert got.dtypes == want.dtypes and rows(got) == rows(want)
    assert rows(U.route_day_rows(U.sums_of_records(rec))) == rows(want)
    assert rows(R.records_from_raw(df)) == rows(rec)


def test_records_of_hashed_payloads_are_the_same(spark, star):
    r = testdata.raw_traffic(spark, star)
    m = TrafficModels(spark, star)
    assert rows(m.records) == rows(R.int_traffic_record(stg_clean(r)))
    assert rows(m.route_day) == rows(U.int_route_day(R.int_traffic_record(stg_clean(r))))


def test_route_day_carries_no_payload_and_no_keys(spark, star):
    p = plan(TrafficModels(spark, star).route_day)
    sorts = [line for line in p.splitlines() if "Sort [" in line or "Exchange hashpartitioning" in line]
    assert sorts and not [line for line in sorts if "record_hash" in line or "raw_payload" in line or "route_key" in line]
    windows = [line for line in p.splitlines() if "WindowGroupLimit" in line]
    assert windows and all("_hash" in line and "raw_payload" not in line for line in windows)


def test_record_tasks_follow_the_input_size(spark, star, monkeypatch):
    assert testdata.record_tasks(spark, star) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(testdata, "BYTES_PER_TASK", 10)
    n = testdata.record_tasks(spark, star)
    assert n > spark.sparkContext.defaultParallelism
    assert f", {n}), REPARTITION_BY_NUM" in plan(testdata.raw_traffic(spark, star))


def test_stored_records_feed_the_route_days(spark, star):
    plain = TrafficModels(spark, star)
    m = TrafficModels(spark, star).materialize(records=True)
    assert rows(m.route_day) == rows(plain.route_day)
    assert rows(m.records) == rows(plain.records)


def test_scope_routes_reads_the_stored_chain(spark):
    p = plan(E.queries()["scope_routes"](spark, SF_SMALL))
    assert "lineitem.parquet" not in p and "int_route_day" in p


def test_casts_of_several_fields_are_counted_in_one_pass(spark):
    df = raw(spark, [
        dict(raw_payload='{"date": "2024-03-06", "passengercount": "10.0", "vehiclecount": 2}'),
        dict(raw_payload='{"date": "2024-03-06", "passengercount": 10.5, "vehiclecount": "x"}'),
        dict(raw_payload='{"date": "2024", "passengercount": "y", "vehiclecount": "x"}'),
    ])
    got = Q.safe_casts_dropped(df, {"passengercount": "passenger_count", "vehiclecount": "vehicle_count"})
    assert [tuple(r) for r in got.collect()] == [("passenger_count", 2), ("vehicle_count", 1)]


def test_landed_casts_read_the_landing_once(spark, star):
    p = plan(E.queries()["dq_landed_casts"](spark, star))
    assert p.split("== Initial Plan ==")[-1].count("FileScan text") == 1
