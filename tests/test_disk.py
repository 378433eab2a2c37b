"""What the traffic chain leaves on disk: shuffles that do not happen, are narrow or are freed, and stored tables that are packed."""

import glob
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from portflow.operators import quality as Q
from portflow.operators import records as R
from portflow.operators import rollups as U
from portflow.operators.staging import stg_clean
from portflow.plans.models import TrafficModels
from portflow.sources import ingest as I
from portflow.sources import sinks
from portflow.sources import testdata
from tests.test_chain_scale import plan, rows, star  # noqa: F401
from tests.test_staging_edges import T1, raw


@pytest.fixture(scope="module")
def odd(spark):
    """Landed rows with copies, and names that are missing, given by ports or spelt as if they were."""
    return raw(spark, [
        dict(record_hash="a", route_code=None, route_name=None, passenger_count="5"),
        dict(record_hash="b", route_code=None, route_name="PIRAEUS -> NAXOS", passenger_count="7"),
        dict(record_hash="c", route_name=None, passenger_count="x"),
        dict(record_hash="d", route_name="PIRAEUS -> NAXOS", vehicle_count=None),
        dict(record_hash="e", route_code=None, route_name=None, departure_port=None),
        dict(record_hash="f", route_code=None, route_name=None, departure_port=None, service_date="2024-04-01"),
        dict(record_hash="0" * 64, service_date="2024-04-02", passenger_count="3"),
        dict(record_hash="1" * 64, service_date="2024-04-02", passenger_count="4"),
        dict(record_hash="1" * 64, service_date="2024-04-02", passenger_count="4", ingested_at=T1),
    ])


def exchanges(df):
    return [line for line in plan(df).split("== Initial Plan ==")[-1].splitlines() if "Exchange" in line]


def test_dedup_of_dealt_records_shuffles_no_hash(spark, star):
    for df in (TrafficModels(spark, star).records, TrafficModels(spark, star).route_day):
        assert exchanges(df) and not [line for line in exchanges(df) if "_hash" in line]


def test_dealt_sums_are_the_route_days(spark, odd):
    clean = R.clean_from_raw(odd)
    want = rows(U.int_route_day(R.int_traffic_record(stg_clean(odd))))
    for tasks in (1, 20):  # one cell a month, several cells a month
        assert rows(U.route_day_rows(U.dealt_route_day_sums(clean, (), tasks))) == want
    kept = R.clean_from_raw(odd, dealt_by=("service_date", "passenger_count"))
    dealt = [R.DEALT + c for c in ("service_date", "passenger_count")]
    assert rows(U.route_day_rows(U.dealt_route_day_sums(kept, dealt, 20))) == want


def test_records_come_back_from_their_base(spark, odd):
    rec = R.records_from_raw(odd)
    assert R.records_of_base(R.record_base(rec)).dtypes == rec.dtypes
    assert rows(R.records_of_base(R.record_base(rec))) == rows(rec)
    null_id = rec.withColumn("event_id", F.lit(None).cast("string")).withColumn("source_record_id", F.col("event_id"))
    assert rows(R.records_of_base(R.record_base(null_id))) == rows(null_id)


def test_weeks_and_months_are_summed_without_keys(spark, odd):
    days = U.int_route_day(R.records_from_raw(odd))
    for grain, fact in (("week", U.fct_route_weekly), ("month", U.fct_route_monthly)):
        want = fact(U.fct_route_daily(days))
        for got in (U.route_period_of_days(days, grain), U.route_period_of_days(days, grain, "year", 20)):
            assert got.dtypes == want.dtypes and rows(got) == rows(want)


def test_weekly_fact_shuffles_no_key(spark, star):
    m = TrafficModels(spark, star).materialize()
    for df in (m.fct_route_weekly, m.fct_route_monthly):
        assert exchanges(df) and not [line for line in exchanges(df) if "route_key" in line or "route_pair_key" in line]


def test_unique_ids_are_told_apart_whatever_they_are(spark, odd):
    ids = ["a" * 64, "a" * 64, "A" * 64, "a" * 63, None, None, "x", "x", "x", ""]
    rec = R.records_from_raw(odd).limit(1).drop("event_id").crossJoin(spark.createDataFrame([(i,) for i in ids], "event_id string"))
    got = {(r.column_name, r.check_name): r.violations for r in Q.run_checks("int_traffic_record", rec).collect()}
    assert got["event_id", "unique"] == 3 and got["event_id", "not_null"] == 2


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in blocks.mkString(",").split(",") if b.startswith("shuffle_")}


def test_writes_free_their_shuffles_and_are_packed(spark, tmp_path):
    before = shuffle_files(spark)
    sinks.write_table(spark.range(1000).groupBy((F.col("id") % 7).alias("m")).count(), str(tmp_path / "t"), ["m"], ["count"])
    sinks.append_landing(spark.range(1000).repartition(3), str(tmp_path / "l"))
    for _ in range(50):
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert glob.glob(f"{tmp_path}/t/m=3/*.zstd.parquet") and glob.glob(f"{tmp_path}/l/*.zstd.parquet")
    assert spark.read.parquet(str(tmp_path / "t")).agg(F.sum("count")).first()[0] == 1000


def test_payloads_land_packed_with_all_records(spark, star, tmp_path):
    records = testdata.star_records(spark, star)
    I.land_payloads(records, str(tmp_path / "p"), records_per_payload=3, odd=True, bad=True)
    assert glob.glob(f"{tmp_path}/p/*.gz") and not glob.glob(f"{tmp_path}/p/*.txt")
    got, bad = I.extract_records(I.read_payloads(spark, str(tmp_path / "p")))
    assert got.count() == records.count() and bad.count() == records.select("date").distinct().count()


def test_summary_holds_one_tables_checks_at_a_time(spark, star):
    df = E.queries()["dq_summary"](spark, star)
    assert "lineitem" not in plan(df) and "checks-of-" in plan(df)
    m = TrafficModels(spark, star).materialize(records=True, payload=False)
    assert "raw_payload" not in m.records.columns and rows(m.records) == rows(TrafficModels(spark, star).records.drop("raw_payload"))


def test_stored_layouts_are_not_shuffled_again(spark, star, monkeypatch):
    seen = {}
    write = sinks.write_table

    def told(df, path, *args, dealt=False, **more):
        seen[path.rsplit("/", 1)[-1]] = dealt
        return write(df, path, *args, dealt=dealt, **more)

    monkeypatch.setattr("portflow.sources.catalogue.write_table", told)
    found = {r.table_name: r.rows_count for r in E.queries()["stored_layouts"](spark, star).collect()}
    assert all(seen[t] for t in ("int_route_day", "fct_route_traffic_daily", "fct_route_traffic_weekly", "fct_route_traffic_monthly"))
    m = TrafficModels(spark, star)
    assert found["int_route_day"] == m.route_day.count()
    assert found["fct_route_traffic_weekly"] == U.fct_route_weekly(U.fct_route_daily(m.route_day)).count()
