"""Window planner, payload extraction, streaming landing."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from portflow.sources import ingest as I


def bounds(spark, s, e):
    return spark.createDataFrame([(dt.date.fromisoformat(s), dt.date.fromisoformat(e))], "start_date date, end_date date")


def test_month_windows_are_chained(spark):
    w = I.plan_windows(bounds(spark, "2024-01-31", "2024-05-10"), "month", 1, 0).orderBy("window_index").collect()
    starts = [r.window_start.isoformat() for r in w]
    assert starts == ["2024-01-31", "2024-02-29", "2024-03-29", "2024-04-29"]
    assert w[0].window_end == dt.date(2024, 2, 28)
    assert w[-1].window_end == dt.date(2024, 5, 10)  # last window clipped


def test_lag_and_day_windows(spark):
    w = I.plan_windows(bounds(spark, "2024-01-10", "2024-01-20"), "day", 5, 2).orderBy("window_index").collect()
    assert [(r.window_start.day, r.window_end.day) for r in w] == [(8, 12), (13, 17), (18, 18)]


def test_start_after_end_is_an_error(spark):
    with pytest.raises(Exception):
        I.plan_windows(bounds(spark, "2024-02-01", "2024-01-01"), "day", 1, 0).collect()


def test_payload_shapes(spark):
    payloads = spark.createDataFrame([
        ('[{"date": "2024-01-01", "passengercount": 3}, 7, null]', "a"),
        ('{"results": [{"date": "2024-01-02"}], "data": [{"date": "x"}]}', "b"),
        ('{"records": null, "data": [{"date": "y"}]}', "c"),
        ('{"data": 3}', "d"),
        ('{"other": []}', "e"),
        ('"text"', "f"),
    ], "payload string, source_file string")
    recs, bad = I.extract_records(payloads)
    dates = sorted(r.date for r in I.records_as_fields(recs).collect())
    assert dates == ["2024-01-01", "2024-01-02"]
    reasons = {r.source_file: r.reason for r in bad.collect()}
    assert set(reasons) == {"c", "d", "e", "f"}
    with pytest.raises(Exception):
        I.extract_records(payloads, strict=True)[0].count()


def test_streaming_landing_appends_once(spark):
    from portflow.streaming.landing import start_landing

    src, land, ckpt = (tempfile.mkdtemp(prefix=p) for p in ("src-", "land-", "ckpt-"))
    spark.createDataFrame([('{"records": [{"date": "2024-01-01", "routecode": "R"}]}',)], "value string") \
        .write.mode("overwrite").text(src + "/batch1")
    q = start_landing(spark, src + "/*", land, ckpt)
    q.awaitTermination(120)
    first = spark.read.parquet(land).count()
    q = start_landing(spark, src + "/*", land, ckpt)  # same files again: nothing new
    q.awaitTermination(120)
    assert first == 1 and spark.read.parquet(land).count() == 1
