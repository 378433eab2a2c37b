"""Parameterised range reads over the warehouse tables (SRC8/SRC9).

Each reader is one ``spark.sql`` statement with named parameters: the
select list prunes columns and the ``BETWEEN`` predicate reaches the parquet
scan (and the partition directories when the table is partitioned).
Weekly/monthly readers filter on the PERIOD START, so a window starting
mid-week loses its first partial week — as the dashboard does.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Select lists of the dashboard readers.
READERS = {
    "daily": ("row_counts_daily", "service_date",
              "service_date, rows_count, distinct_itineraries, distinct_route_pairs, distinct_departure_ports, "
              "distinct_arrival_ports, total_passengers, total_vehicles"),
    "weekly": ("row_counts_weekly", "week_start",
               "week_start, rows_count, total_passengers, total_vehicles, distinct_route_pairs, distinct_departure_ports, "
               "distinct_arrival_ports"),
    "monthly": ("row_counts_monthly", "year_month",
                "year_month, rows_count, total_passengers, total_vehicles, distinct_route_pairs, distinct_departure_ports, "
                "distinct_arrival_ports"),
    "routes": ("fct_route_traffic_daily", "service_date",
               "service_date, departure_port, arrival_port, traffic_record_count, total_passengers, total_vehicles"),
    "ports": ("fct_port_activity_daily", "service_date",
              "service_date, port_name, departure_record_count, arrival_record_count, total_departing_passengers, "
              "total_arriving_passengers, total_departing_vehicles, total_arriving_vehicles"),
}


def range_read(spark: SparkSession, table: DataFrame, reader: str, start: _dt.date | str | Column, end: _dt.date | str | Column) -> DataFrame:
    """Run the named reader against ``table`` for [start, end] (inclusive).

    Dates are named parameters of the statement; bounds that are columns
    (scalar subqueries over a table) are compared as they are, so nothing
    runs when the reader is built.
    """
    _name, col, select_list = READERS[reader]
    if isinstance(start, Column) or isinstance(end, Column):
        return table.where(F.col(col).between(start, end)).select(*[c.strip() for c in select_list.split(",")]).orderBy(col)
    s, e = (d if isinstance(d, _dt.date) else _dt.date.fromisoformat(str(d)) for d in (start, end))
    return spark.sql(
        f"SELECT {select_list} FROM {{source}} WHERE {col} BETWEEN :start_date AND :end_date ORDER BY {col}",
        args={"start_date": s, "end_date": e}, source=table,
    )
