"""Stored layouts: pruning by period, state without reading data, buckets without a shuffle."""

import datetime as dt

from pyspark.sql import functions as F

from portflow.operators import rollups as U
from portflow.plans.models import TABLE_ATTRS, TrafficModels
from portflow.sources.catalogue import LAYOUTS, TOKEN_TABLES, Catalogue, bucketed
from tests.conftest import SF_SMALL
from tests.test_plans import plan


def days(spark, n=90):
    return spark.range(n).select(F.date_add(F.lit("2024-01-15").cast("date"), F.col("id").cast("int")).alias("service_date"), F.col("id").alias("rows_count"))


def test_every_model_has_a_layout_of_columns_it_has(spark):
    m = TrafficModels(spark, SF_SMALL)
    for table, attr in TABLE_ATTRS.items():
        layout, columns = LAYOUTS[table], getattr(m, attr).columns
        assert set(layout.cluster) <= set(columns) and layout.grain in (None, *columns), table


def test_range_reads_list_only_their_periods(spark, tmp_path):
    cat = Catalogue(spark, str(tmp_path))
    cat.write("int_port_day", days(spark).withColumn("port_name", F.lit("x")))
    got = cat.read("int_port_day", F.lit("2024-02-10").cast("date"), F.lit("2024-03-02").cast("date"))
    assert got.columns == ["service_date", "rows_count", "port_name"] and got.count() == 22
    assert "PartitionFilters: [isnotnull(period" in plan(got)
    assert {r[0] for r in spark.read.parquet(cat.path("int_port_day")).select("period").distinct().collect()} == {dt.date(2024, m, 1) for m in (1, 2, 3, 4)}
    cat.write("int_port_day", days(spark, 0).withColumn("port_name", F.lit("x")))  # replaced, empty
    assert not list(tmp_path.glob("int_port_day/period=*"))


def test_token_changes_with_the_table_written_again(spark, tmp_path):
    cat = Catalogue(spark, str(tmp_path))
    for t in TOKEN_TABLES:
        df = days(spark, 5).withColumns({c: F.lit("x") for c in LAYOUTS[t].cluster if c != "service_date"})
        cat.write(t, df)
    first = cat.token().first()[0]
    assert first == cat.token().first()[0] and [p.split(":")[0] for p in first.split("|")] == sorted(TOKEN_TABLES)
    assert all(p.endswith(":5") for p in first.split("|"))
    assert "ReadSchema: struct<>" in plan(cat.state())  # no data column is read
    cat.write("row_counts_daily", days(spark, 5))
    changed = [a.split(":")[0] for a, b in zip(first.split("|"), cat.token().first()[0].split("|")) if a != b]
    assert changed == ["row_counts_daily"]


def test_bucketed_facts_are_summed_without_a_shuffle(spark):
    daily = bucketed(TrafficModels(spark, SF_SMALL).materialize().fct_route_daily, 8)
    for mart in (U.fct_route_weekly(daily), U.fct_route_monthly(daily), daily.groupBy("route_pair_key").count()):
        assert "Exchange" not in plan(mart)
    assert "Exchange" in plan(daily.groupBy("service_date").count())
