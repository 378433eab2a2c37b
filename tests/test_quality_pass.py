"""Checks counted in one pass; the audit of a load taken while it is written."""

import datetime as dt
import json

from pyspark.sql import functions as F

from portflow.functions.text import unicode_trim
from portflow.operators import quality as Q
from portflow.operators.staging import DATE_PATTERN, INT_PATTERN, safe_date, safe_int
from portflow.plans.models import TrafficModels
from portflow.sources import ingest as I
from tests.conftest import SF_SMALL
from tests.test_plans import plan


def counted(df):
    return {(r.column_name, r.check_name): r.violations for r in df.collect()}


def test_unique_and_row_checks_in_one_pass(spark):
    rows = [("a", 1), ("a", 0), ("a", None), ("b", -1), (None, 3), (None, -2)]
    df = spark.createDataFrame(rows, "k string, n int")
    checks = [("k", "not_null"), ("k", "unique"), ("n", "positive"), ("n", "non_negative"), ("n", "unique")]
    got = counted(Q.run_checks("t", df, checks))
    # two rows too many of 'a', missing keys are not duplicates; 0, -1 and -2 are not positive
    assert got == {("k", "not_null"): 2, ("k", "unique"): 2, ("n", "positive"): 3, ("n", "non_negative"): 2, ("n", "unique"): 0}
    assert set(counted(Q.run_checks("t", df.limit(0), checks)).values()) == {0}
    one = Q.run_checks("t", df, checks[:4])
    assert plan(one).count("Scan") == 1 or plan(one).count("LocalTableScan") == 1


def test_a_table_dealt_by_its_key_is_not_shuffled_again(spark):
    m = TrafficModels(spark, SF_SMALL)
    alone, checked = plan(m.dim_route).count("Exchange hash"), plan(Q.run_checks("dim_route", m.dim_route)).count("Exchange hash")
    assert checked <= alone


def test_collisions_by_least_and_greatest(spark):
    rec = "route_key string, route_pair_key string, route_code string, route_name string, departure_port string, arrival_port string"
    rows = [("r1", "p1", "A", "n", "x", "y")] * 3 + [("r1", "p2", "B", "n", "x", "z"), ("r2", "p3", "C", None, "x", "y"), ("r3", "p3", "C", None, "x", "y"),
            ("r4", "p4", None, None, None, None), ("r5", "p5", "D", "n", "u", "v"), ("r5", "p5", "D", "n", "u", "w")]
    got = {r.check_name: r.violations for r in Q.collision_checks(spark.createDataFrame(rows, rec)).collect()}
    assert got == {"route_key_has_no_hash_collisions": 1, "route_pair_key_has_no_hash_collisions": 1, "route_pair_key_maps_to_single_route_key": 1}
    assert plan(Q.collision_checks(spark.createDataFrame(rows, rec))).count("Exchange hashpartitioning(route_pair_key") >= 1


def landing(spark, days):
    rows = [(f"h{i}", d) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "record_hash string, service_date string")


def test_load_audit_counts_while_writing(spark, tmp_path, monkeypatch):
    windows = spark.createDataFrame([(0, dt.date(2024, 1, 1), dt.date(2024, 1, 31)), (1, dt.date(2024, 2, 1), dt.date(2024, 2, 29)), (2, dt.date(2024, 3, 1), dt.date(2024, 3, 5))],
                                    "window_index int, window_start date, window_end date")
    raw = landing(spark, ["2024-01-01", "2024-01-31", "2024-03-05", "2024-03-06", "bad", None])
    path = str(tmp_path / "landing")
    by_write = [tuple(r) for r in I.land_and_audit(raw, path, windows).orderBy("window_index").collect()]
    assert [(r[3], r[4]) for r in by_write] == [(2, "loaded"), (0, "empty"), (1, "loaded")] and {r[5:] for r in by_write} == {(3, 1, 3, 6)}
    second = I.land_and_audit(landing(spark, ["2024-02-02"]), path, windows).orderBy("window_index").collect()
    assert [r.rows_loaded for r in second] == [0, 1, 0] and second[0].rows_written == 1  # of this load alone
    # more windows than are observed, and a count that the files do not confirm: the audit is read from what was written
    monkeypatch.setattr(I, "MAX_OBSERVED", 2)
    assert [tuple(r) for r in I.land_and_audit(raw, str(tmp_path / "b"), windows).orderBy("window_index").collect()] == by_write
    assert I.land_and_audit(raw.limit(0), str(tmp_path / "c"), windows).agg(F.sum("rows_loaded")).first()[0] == 0


# Dates and numbers as they come: plain, in white space of all kinds, at a line end, too long, in other digits, none.
DATES = ["2024-03-06", "2024-3-6", " 2024-03-06", "2024-03-06\n", "2024-03-06\u0085", " 2024-03-06 ", "2024-13-06", "2024-03-06x", "2024", "٢٠٢٤-03-06", "", None]
NUMBERS = ["5", "+5", "-5", " 5", "-5\n", "7\u0085", " 7 ", "- 7", "9" * 18, "-" + "9" * 18, "9" * 19, "9223372036854775807", "5.0", "x", "٥", "+", " ", "", None]


def test_plain_values_are_cast_as_trimmed_ones(spark):
    dates, numbers = spark.createDataFrame([(d,) for d in DATES], "v string"), spark.createDataFrame([(n,) for n in NUMBERS], "v string")
    t = unicode_trim(F.col("v"))
    for df, got, want in ((dates, safe_date(F.col("v")), F.when(t.rlike(DATE_PATTERN), t.try_cast("date"))),
                          (numbers, safe_int(F.col("v")), F.when(t.rlike(INT_PATTERN), t.try_cast("long")))):
        rows = df.select("v", got.alias("got"), want.alias("want")).collect()
        assert [r for r in rows if r.got != r.want] == [] and any(r.got is not None for r in rows) and any(r.got is None for r in rows)


def test_landing_checks_of_every_date_and_number(spark):
    rows = [(f"h{d}-{n}", d, n, n, json.dumps({"date": d, "passengercount": n, "vehiclecount": n})) for d in DATES for n in NUMBERS]
    df = spark.createDataFrame(rows, "record_hash string, service_date string, passenger_count string, vehicle_count string, raw_payload string")
    dates = df.where(safe_date(F.col("service_date")).isNotNull()).select("service_date").distinct().count()
    # negative: three that cast; dropped: not empty, no whole number of 64 bits
    assert dates == 6 and counted(Q.landing_checks(df)) == {
        ("record_hash", "not_null"): 0,
        **{(c, "non_negative"): dates * 3 for c in ("passenger_count", "vehicle_count")},
        **{(c, f"{c}_safe_cast_did_not_drop_values"): dates * 6 for c in ("passenger_count", "vehicle_count")},
    }


def test_plain_counts_need_no_trimming(spark):
    """Whole numbers are told by one match each; what is trimmed, and the date, stand in the other branch."""
    rows = [("h", "2024-03-06", "1", "2", "{}")]
    df = spark.createDataFrame(rows, "record_hash string, service_date string, passenger_count string, vehicle_count string, raw_payload string")
    for c in (Q.cast_dropped("passengercount"), safe_int(F.col("passenger_count")), safe_date(F.col("service_date"))):
        tree = df.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
        first = tree.split(" THEN ")[0]
        assert "RLIKE" in first and "regexp_replace" not in first
