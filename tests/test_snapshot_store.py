import glob
import os

import pytest
from pyspark.sql import functions as F

from portflow.sources.sinks import SNAPSHOT_KEY
from portflow.sources.snapshot_store import SnapshotStore

SCHEMA = "snapshot_ts string, chart_id string, insight_type string, data_version string, filter_hash string, title string, facts array<string>"


def rows(spark, *items):
    """Items of (snapshot_ts, chart_id, data_version, filter_hash, title)."""
    return spark.createDataFrame([(ts, c, "auto", v, h, t, [t]) for ts, c, v, h, t in items], SCHEMA)


def files(path):
    return {f[len(path) :]: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/of-*/bucket=*/*.parquet")}


def table(store):
    return sorted((r.chart_id, r.data_version, r.filter_hash or "", r.filter_hash is None, r.snapshot_ts, r.title, tuple(r.facts)) for r in store.read().collect())


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "snaps")
    store = SnapshotStore.create(rows(spark, *[("t0", f"c{i}", "v1", None, f"old {i}") for i in range(200)]), path, 16)
    before, was = files(path), table(store)
    assert {f.split("/")[2] for f in before} == {f"bucket={i}" for i in range(16)} and len(was) == 200
    touched = store.upsert(rows(spark, ("t1", "c7", "v1", "", "new 7"), ("t1", "c300", "v1", "h", "new 300")))
    after = files(path)
    assert 1 <= len(touched) <= 2
    same = {f: t for f, t in before.items() if int(f.split("=")[1].split("/")[0]) not in touched}
    assert {f: t for f, t in after.items() if int(f.split("=")[1].split("/")[0]) not in touched} == same
    changed = set(table(store)) ^ set(was)
    # the matched row keeps its NULL hash and takes all else; the other is new
    assert changed == {("c7", "v1", "", True, "t0", "old 7", ("old 7",)), ("c7", "v1", "", True, "t1", "new 7", ("new 7",)), ("c300", "v1", "h", False, "t1", "new 300", ("new 300",))}


def test_successive_upserts_and_no_change(spark, tmp_path):
    path = str(tmp_path / "snaps")
    store = SnapshotStore.create(rows(spark, ("t0", "a", "v1", None, "x")), path, 8)
    first = rows(spark, ("t1", "a", "v1", None, "y"), ("t1", "b", "v2", "h", "z"))
    assert store.upsert(first)
    seen = files(path)
    assert store.upsert(first) == [] and files(path) == seen  # repeated: nothing is written
    assert store.upsert(rows(spark, ("t2", "b", "v2", "h", "w"))) and store.upsert(rows(spark)) == []
    again = SnapshotStore(spark, path, store.schema)
    assert [(r[0], r[4], r[5]) for r in table(again)] == [("a", "t1", "y"), ("b", "t2", "w")]


def test_double_match_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "snaps")
    store = SnapshotStore.create(rows(spark, ("t0", "a", "v1", None, "x")), path, 8)
    seen = files(path)
    with pytest.raises(Exception, match="several source rows match"):
        store.upsert(rows(spark, ("t1", "a", "v1", None, "y"), ("t2", "a", "v1", "", "z")))
    assert files(path) == seen
    with pytest.raises(ValueError, match="there is a snapshot table"):
        SnapshotStore.create(rows(spark), path, 3)
    with pytest.raises(ValueError, match="no snapshot table"):
        SnapshotStore(spark, str(tmp_path / "none"), store.schema)
    assert SnapshotStore(spark, path, store.schema).buckets == 8


def test_plan_reads_touched_directories_only(spark, tmp_path):
    path = str(tmp_path / "snaps")
    store = SnapshotStore.create(rows(spark, *[("t0", f"c{i}", "v1", None, "x") for i in range(50)]), path, 8)
    plan = store.stored().where(F.col("bucket").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    assert store.read().columns[1:5] == SNAPSHOT_KEY
