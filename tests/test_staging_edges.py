"""Hand-made edge rows (FIXTURES §3) through staging and the canonical record."""

import datetime as dt

from pyspark.sql import functions as F

from portflow.operators.records import int_traffic_record
from portflow.operators.staging import stg_clean
from portflow.plans.models import TrafficModels
from portflow.operators import rollups as U

RAW_SCHEMA = ("record_hash string, service_date string, route_code string, route_name string, departure_port string, "
              "arrival_port string, passenger_count string, vehicle_count string, ingested_at timestamp_ntz, raw_payload string")
T0 = dt.datetime(2026, 1, 1, 6)
T1 = dt.datetime(2026, 1, 2, 6)


def raw(spark, rows):
    full = []
    for i, r in enumerate(rows):
        base = dict(record_hash=f"h{i}", service_date="2024-03-06", route_code="R1", route_name="A - B",
                    departure_port="PIRAEUS", arrival_port="NAXOS", passenger_count="10", vehicle_count="2",
                    ingested_at=T0, raw_payload="{}")
        base.update(r)
        full.append(tuple(base[k] for k in ("record_hash", "service_date", "route_code", "route_name", "departure_port",
                                           "arrival_port", "passenger_count", "vehicle_count", "ingested_at", "raw_payload")))
    return spark.createDataFrame(full, RAW_SCHEMA)


def test_whitespace_accents_and_blanks(spark):
    nbsp = "\u00a0"
    df = raw(spark, [
        dict(record_hash="a", departure_port="\t Πειραιάς \n", arrival_port=f"{nbsp}Νάξος{nbsp}", route_code="  R  1 "),
        dict(record_hash="b", departure_port=f"ΑΓΙΟΣ{nbsp}ΚΗΡΥΚΟΣ", arrival_port="", route_code="  ", route_name=""),
        dict(record_hash="c", departure_port="ΐ", arrival_port="  "),
    ])
    out = {r.record_hash: r for r in stg_clean(df).collect()}
    assert out["a"].departure_port == "ΠΕΙΡΑΙΑΣ"
    assert out["a"].arrival_port == "ΝΑΞΟΣ"  # outer NBSP removed
    assert out["a"].route_code == "R 1"
    assert out["b"].departure_port == f"ΑΓΙΟΣ{nbsp}ΚΗΡΥΚΟΣ"  # inner NBSP kept: \s is ASCII
    assert out["b"].arrival_port is None and out["b"].route_code is None
    assert out["b"].route_name is None  # blank column value wins over the payload and becomes NULL
    assert out["c"].arrival_port is None
    assert out["c"].departure_port not in ("Ι",)  # only the 9-letter literal fold


def test_route_name_falls_back_to_payload(spark):
    df = raw(spark, [dict(route_name=None, raw_payload='{"route_name": " From  payload "}')])
    assert stg_clean(df).first().route_name == "From payload"


def test_bad_numbers_and_dates(spark):
    df = raw(spark, [
        dict(record_hash="n1", passenger_count="12.0"), dict(record_hash="n2", passenger_count="x"),
        dict(record_hash="n3", passenger_count=""), dict(record_hash="n4", passenger_count=" 12 "),
        dict(record_hash="d1", service_date="2026"), dict(record_hash="d2", service_date="06/03/2026"),
        dict(record_hash="d3", service_date=None), dict(record_hash="d4", service_date="2026-03-06T10:00"),
    ])
    out = {r.record_hash: r.passenger_count for r in stg_clean(df).collect()}
    assert out == {"n1": None, "n2": None, "n3": None, "n4": 12}


def test_keys_fallbacks_and_calendar(spark):
    df = raw(spark, [
        dict(record_hash="k1", route_code=None, route_name=None, departure_port=None),
        dict(record_hash="s1", service_date="2023-12-01"), dict(record_hash="s2", service_date="2024-02-28"),
        dict(record_hash="s3", service_date="2024-03-01"), dict(record_hash="s4", service_date="2024-08-31"),
        dict(record_hash="s5", service_date="2024-09-01"), dict(record_hash="w1", service_date="2023-01-01"),
    ])
    rec = {r.event_id: r for r in int_traffic_record(stg_clean(df)).collect()}
    import hashlib

    k1 = rec["k1"]
    assert k1.route_key == hashlib.sha256(b"unknown_itinerary|unknown_departure|NAXOS").hexdigest()
    assert k1.route_pair_key == hashlib.sha256(b"||NAXOS").hexdigest()
    assert k1.route_name == "Unknown departure -> NAXOS"
    seasons = {k: rec[k].service_season for k in ("s1", "s2", "s3", "s4", "s5")}
    assert seasons == {"s1": "winter", "s2": "winter", "s3": "spring", "s4": "summer", "s5": "autumn"}
    assert rec["w1"].service_week_start == dt.date(2022, 12, 26)  # Sunday 1 Jan → Monday of the previous year


def test_dedup_keeps_newest(spark):
    df = raw(spark, [dict(record_hash="x", ingested_at=T0, passenger_count="1"),
                     dict(record_hash="x", ingested_at=T1, passenger_count="2")])
    rows = int_traffic_record(stg_clean(df)).collect()
    assert len(rows) == 1 and rows[0].passenger_count == 2


def test_null_counts_daily_vs_weekly_average(spark):
    df = raw(spark, [dict(record_hash="p1", passenger_count="10"), dict(record_hash="p2", passenger_count=None)])
    m = TrafficModels(spark, raw=df)
    day = m.route_day.first()
    assert day.avg_passengers_per_record == 10.0  # AVG over non-null
    week = m.fct_route_weekly.first()
    assert week.avg_passengers_per_record == 5.0  # divides by all records


def test_null_ports_fail_route_checks(spark):
    from portflow.operators.quality import run_checks

    df = raw(spark, [dict(record_hash="q1", departure_port=None), dict(record_hash="q2", arrival_port=None)])
    m = TrafficModels(spark, raw=df)
    res = {(r.column_name, r.check_name): r.violations for r in run_checks("int_route_day", m.route_day).collect()}
    assert res[("departure_port", "not_null")] == 1 and res[("arrival_port", "not_null")] == 1
    # port movements drop the missing side
    assert m.port_movement.count() == 2


def test_landing_checks_count_violations(spark):
    from portflow.operators.quality import custom_checks, landing_checks, run_checks

    df = raw(spark, [
        dict(record_hash="v1", passenger_count="-3", raw_payload='{"date": "2024-03-06", "passengercount": -3}'),
        dict(record_hash="v2", passenger_count="x", raw_payload='{"date": "2024-03-06", "passengercount": "x"}'),
        dict(record_hash="v3", vehicle_count="12.0", raw_payload='{"date": "2024-03-06", "vehiclecount": "12.0"}'),
        dict(record_hash="v4", service_date="bad", passenger_count="-1", raw_payload='{"date": "bad", "passengercount": "y"}'),
    ])
    got = {(r.column_name, r.check_name): r.violations for r in landing_checks(df).collect()}
    assert got[("passenger_count", "non_negative")] == 1  # the row with a bad date is not staged
    assert got[("passenger_count", "passenger_count_safe_cast_did_not_drop_values")] == 1
    assert got[("vehicle_count", "vehicle_count_safe_cast_did_not_drop_values")] == 1
    # Same numbers as the per-table runner and the custom checks.
    per_table = {(r.column_name, r.check_name): r.violations
                 for r in run_checks("stg_sailing_traffic", stg_clean(df)).collect()}
    assert per_table[("passenger_count", "non_negative")] == 1
    rec = int_traffic_record(stg_clean(df))
    custom = {r.check_name: r.violations for r in custom_checks(df, rec).collect()}
    assert custom["passenger_count_safe_cast_did_not_drop_values"] == 1
