"""Stored tables with their layouts: what each table is partitioned and clustered by, and what state it is in.

A table with a date grain lies in directories of that grain's *period* — a
month of days, a year of weeks or months — so that a directory holds files
worth opening, and within files rows are sorted by the cluster columns, which
makes the row groups' least and greatest values selective. ``read`` takes a
date range and writes it on the period too, so directories outside it are
never listed. Tables without a grain are clustered only.

``bucketed`` stores a route fact dealt by ``route_pair_key``: whatever groups
by it and more (the weekly and monthly marts do) reads the files as they lie,
without a shuffle. A route pair has a row a day at most, so no bucket grows
with one busy pair.

``state`` looks at files, not at rows: the times and row counts that the
stored files themselves state. ``token`` is made of it: it changes whenever
one of the tables is written again, and no data column is read for it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portflow.sources.sinks import scratch_path, write_table

PERIOD = "period"


@dataclass(frozen=True)
class Layout:
    """``grain``: the date column; ``unit``: the span of a directory; ``cluster``: what rows are sorted by in files."""

    grain: str | None = None
    unit: str = "month"
    cluster: tuple[str, ...] = ()

    def period(self) -> Column:
        day = F.make_date(F.col(self.grain), F.lit(1), F.lit(1)) if self.grain == "year" else F.col(self.grain).try_cast("date")
        return F.trunc(day, self.unit)


_CORRIDOR = ("departure_port", "arrival_port", "route_pair_key")
# Grain and cluster columns of every table.
LAYOUTS = {
    "raw_sailing_traffic": Layout("service_date", "month", ("record_hash",)),
    "stg_sailing_traffic": Layout("service_date", "month", ("route_code", "departure_port", "arrival_port")),
    "int_traffic_record": Layout("service_date", "month", ("route_pair_key", "departure_port", "arrival_port")),
    "int_route_day": Layout("service_date", "month", _CORRIDOR),
    "int_port_movement": Layout("service_date", "month", ("movement_type", "port_name")),
    "int_port_day": Layout("service_date", "month", ("port_name",)),
    "dim_port": Layout(cluster=("port_name",)),
    "dim_route": Layout(cluster=("route_key",)),
    "dim_route_pair": Layout(cluster=("route_pair_key",)),
    "fct_route_traffic_daily": Layout("service_date", "month", _CORRIDOR),
    "fct_route_traffic_weekly": Layout("week_start", "year", _CORRIDOR),
    "fct_route_traffic_monthly": Layout("year_month", "year", _CORRIDOR),
    "fct_port_activity_daily": Layout("service_date", "month", ("port_name",)),
    "fct_port_activity_weekly": Layout("week_start", "year", ("port_name",)),
    "fct_port_activity_monthly": Layout("year_month", "year", ("port_name",)),
    "row_counts_daily": Layout("service_date", "year", ("service_date",)),
    "row_counts_weekly": Layout("week_start", "year", ("week_start",)),
    "row_counts_monthly": Layout("year_month", "year", ("year_month",)),
    "row_counts_yearly": Layout(cluster=("year",)),
    "intelligence_snapshots": Layout(cluster=("chart_id", "insight_type")),
}
# The tables whose state a dashboard's refresh token is made of.
TOKEN_TABLES = ("row_counts_daily", "fct_route_traffic_daily", "fct_port_activity_daily", "intelligence_snapshots")


class Catalogue:
    """Tables under one folder, each in its layout."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or scratch_path(spark, "catalogue")).rstrip("/")
        self.schemas: dict[str, DataFrame] = {}

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, table: str, df: DataFrame, dealt: bool = False) -> None:
        """Replace a table. Rows whose date is no date lie in a directory of their own.

        ``dealt``: the rows of a directory lie in few tasks already, so that nothing is shuffled for the write.
        """
        layout = LAYOUTS[table]
        grained = layout.grain is not None
        out = df.withColumn(PERIOD, layout.period()) if grained else df
        write_table(out, self.path(table), [PERIOD] if grained else None, [*([layout.grain] if grained else []), *layout.cluster], dealt=dealt)
        self.schemas[table] = df.limit(0)

    def read(self, table: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
        """A table, or its rows from ``start`` to ``end`` of its grain."""
        layout, df = LAYOUTS[table], self.spark.read.parquet(self.path(table))
        for bound, keep in ((start, lambda c, b: c >= b), (end, lambda c, b: c <= b)):
            if bound is not None:
                df = df.where(keep(F.col(layout.grain), bound) & keep(F.col(PERIOD), F.trunc(bound, layout.unit)))
        if PERIOD in df.columns:
            df = df.drop(PERIOD)
        return df

    def state(self, tables: tuple[str, ...] = TOKEN_TABLES) -> DataFrame:
        """table_name, rows_count, files, last_modified (microseconds), from the files' own statements."""
        parts = []
        for t in tables:
            files = self.spark.read.parquet(self.path(t)).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t"))
            parts.append(files.groupBy("f", "t").agg(F.count(F.lit(1)).alias("n")).agg(
                F.lit(t).alias("table_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_count"), F.count("f").alias("files"),
                F.coalesce(F.unix_micros(F.max("t")), F.lit(0)).alias("last_modified")))
        return reduce(DataFrame.unionByName, parts)

    def token(self, tables: tuple[str, ...] = TOKEN_TABLES) -> DataFrame:
        """One row, ``data_token``: each table's name, last change and rows, in the order of names."""
        part = F.concat_ws(":", "table_name", F.col("last_modified").cast("string"), F.col("rows_count").cast("string"))
        return self.state(tables).agg(F.array_join(F.sort_array(F.collect_list(part)), "|").alias("data_token"))


def bucketed(df: DataFrame, buckets: int, key: str = "route_pair_key", sort: tuple[str, ...] = ("service_date",)) -> DataFrame:
    """``df`` stored as a table dealt into ``buckets`` by ``key`` and read back; equal keys lie in one bucket, sorted."""
    spark = df.sparkSession
    name = f"portflow_{uuid.uuid4().hex[:12]}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *sort)
    writer.format("parquet").option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)
