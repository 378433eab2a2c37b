"""Plan shape: dedup pre-limits before the shuffle, no Python in plans, pruning reaches the scan."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from portflow.operators import snapshots as S
from portflow.plans.models import TrafficModels
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_uses_window_group_limit(spark):
    m = TrafficModels(spark, SF_SMALL)
    p = m.records._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in p


def test_no_python_udfs_in_registered_queries(spark):
    qs = E.queries()
    for k in ("int_traffic_record", "row_counts_daily", "dq_summary", "window_kpis", "concentration_weekly",
              "snap_deepen_rows", "top_corridors"):
        p = plan(qs[k](spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, k


def test_registered_snapshot_queries_prune_months(spark):
    qs = E.queries()
    for k in ("snap_corridors", "snap_deepen_rows"):
        p = plan(qs[k](spark, SF_SMALL))
        assert "PartitionFilters: [isnotnull(service_month_start" in p and "Subquery" in p, k


def test_month_writes_are_not_one_task_a_month(spark, tmp_path):
    from portflow.sources.sinks import write_table

    df = spark.range(10).select("id", (F.col("id") % 2).alias("m"))
    p = df.hint("rebalance", "m")._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in p
    write_table(df, str(tmp_path / "t"), ["m"], ["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_snapshot_scope_prunes_month_partitions(spark):
    m = TrafficModels(spark, SF_SMALL).materialize(records=True)
    scope = S.scope_bounds(m.daily)
    rec = S.in_scope(m.records, scope, month_col="service_month_start")
    p = plan(rec.select("service_date"))
    assert "PartitionFilters: [isnotnull(service_month_start" in p and "Subquery" in p


def test_column_pruning_reaches_scan(spark):
    m = TrafficModels(spark, SF_SMALL)
    p = plan(m.row_counts_daily)
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_quantity:double>" in p
