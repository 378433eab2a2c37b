"""Rollups: route-day and port-day intermediates, dimensions, facts, row counts.

Weekly and monthly facts aggregate the day grain, never the records again.
Distinct counts (row counts reports) read the route-day grain, whose grouping
key holds every counted column; they never add up distinct counts of days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portflow.functions.calendar import month_start, week_start
from portflow.functions.keys import route_key, route_pair_key
from portflow.functions.numeric import round_ratio
from portflow.operators.records import nameless, nameless_pair_key, shown_name

ROUTE_ATTRS = ["route_key", "route_pair_key", "route_code", "route_name", "departure_port", "arrival_port"]
CALENDAR = ["service_date", "service_week_start", "service_month_start", "service_year"]
PORT_MEASURES = [
    "departure_record_count",
    "arrival_record_count",
    "total_departing_passengers",
    "total_arriving_passengers",
    "total_departing_vehicles",
    "total_arriving_vehicles",
]


def _route_day_measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("traffic_record_count"),
        F.coalesce(F.sum("passenger_count"), F.lit(0)).cast("long").alias("total_passengers"),
        F.coalesce(F.sum("vehicle_count"), F.lit(0)).cast("long").alias("total_vehicles"),
        # AVG over non-null values, rounded on the exact ratio.
        round_ratio(F.sum("passenger_count"), F.count("passenger_count")).alias("avg_passengers_per_record"),
        round_ratio(F.sum("vehicle_count"), F.count("vehicle_count")).alias("avg_vehicles_per_record"),
    ]


def int_route_day(rec: DataFrame) -> DataFrame:
    """INT1: one row per day × itinerary × corridor attributes."""
    return rec.groupBy(*CALENDAR, *ROUTE_ATTRS).agg(*_route_day_measures())


# What the calendar columns and keys of a route-day row are made of.
ROUTE_DAY_BASE = ["service_date", "route_code", "route_name", "departure_port", "arrival_port", "nameless"]


def route_day_sums(clean: DataFrame) -> DataFrame:
    """INT1 without the columns that its others give: the groups of ``int_route_day`` by what keys and calendar are made of.

    Two rows of one code, name and corridor have the same keys unless one of
    them got its name from its ports (``nameless``): the same groups, shuffled
    without two keys and three dates a row.
    """
    base = clean.withColumn("nameless", nameless()).withColumn("route_name", shown_name())
    return base.groupBy(*ROUTE_DAY_BASE).agg(*_route_day_measures())


def dealt_route_day_sums(clean: DataFrame, dealt_by: Sequence[str], tasks: int) -> DataFrame:
    """``route_day_sums`` with the month, dealt into directories of months as a write wants them, by one shuffle.

    Rows that are dealt by ``dealt_by``, which stand beside the cleaned
    columns, are summed where they lie; what is left meets the rows of its
    group in one of a month's cells. A month has more cells the more
    ``tasks`` there are, so that no month is bound to one task.
    """
    base = clean.withColumn("nameless", nameless()).withColumn("route_name", shown_name())
    sums = [F.count(F.lit(1)).alias("records")]
    for c in ("passenger_count", "vehicle_count"):
        sums += [F.sum(c).alias(c), F.count(c).alias(f"{c}_known")]
    here = base.groupBy(*dealt_by, *ROUTE_DAY_BASE).agg(*sums) if dealt_by else base.select(
        *ROUTE_DAY_BASE, F.lit(1).cast("long").alias("records"),
        *[x for c in ("passenger_count", "vehicle_count") for x in (F.col(c), F.col(c).isNotNull().cast("long").alias(f"{c}_known"))])
    met = in_cells(here.withColumn("service_month_start", month_start(F.col("service_date"))), "service_month_start", ROUTE_DAY_BASE, tasks)
    return met.groupBy("service_month_start", CELL, *ROUTE_DAY_BASE).agg(
        F.sum("records").alias("traffic_record_count"),
        F.coalesce(F.sum("passenger_count"), F.lit(0)).cast("long").alias("total_passengers"),
        F.coalesce(F.sum("vehicle_count"), F.lit(0)).cast("long").alias("total_vehicles"),
        round_ratio(F.sum("passenger_count"), F.sum("passenger_count_known")).alias("avg_passengers_per_record"),
        round_ratio(F.sum("vehicle_count"), F.sum("vehicle_count_known")).alias("avg_vehicles_per_record"),
    ).drop(CELL)


CELL = "_cell"
TASKS_PER_CELL = 8  # fixed value: a directory is dealt over one of so many tasks


def in_cells(df: DataFrame, directory: str, group: Sequence[str], tasks: int) -> DataFrame:
    """``df`` dealt over ``tasks`` by its directory and one of the directory's cells; rows of a ``group`` share a cell."""
    cells = -(-tasks // TASKS_PER_CELL)
    return df.withColumn(CELL, F.pmod(F.xxhash64(*group), F.lit(cells)).cast("int")).repartition(tasks, directory, CELL)


def tell_nameless(rows: DataFrame) -> DataFrame:
    """``nameless`` of canonical records or route-day rows: a pair key without code and name tells it."""
    return rows.withColumn("nameless", F.col("route_code").isNull() & (F.col("route_pair_key") == nameless_pair_key()))


def sums_of_records(rec: DataFrame) -> DataFrame:
    """``route_day_sums`` of canonical records."""
    return tell_nameless(rec).groupBy(*ROUTE_DAY_BASE).agg(*_route_day_measures())


def route_day_rows(sums: DataFrame) -> DataFrame:
    """INT1 from ``route_day_sums``: calendar and keys of each row."""
    d, code, dep, arr = (F.col(c) for c in ("service_date", "route_code", "departure_port", "arrival_port"))
    name = F.when(~F.col("nameless"), F.col("route_name"))
    made = {
        "service_week_start": week_start(d), "service_month_start": month_start(d), "service_year": F.year(d),
        "route_key": route_key(code, name, dep, arr), "route_pair_key": route_pair_key(code, name, dep, arr),
    }
    return sums.withColumns(made).select(*CALENDAR, *ROUTE_ATTRS, *[c for c in sums.columns if c not in ROUTE_DAY_BASE + CALENDAR])


def int_port_movement(rec: DataFrame) -> DataFrame:
    """INT2: each record seen from each of its non-null ports.

    One scan: explode a two-element array instead of a union of two scans.
    """
    sides = F.array(
        F.struct(F.lit("departure").alias("movement_type"), F.col("departure_port").alias("port_name")),
        F.struct(F.lit("arrival").alias("movement_type"), F.col("arrival_port").alias("port_name")),
    )
    return (
        rec.select("event_id", *CALENDAR, F.explode(sides).alias("m"), "passenger_count", "vehicle_count")
        .where(F.col("m.port_name").isNotNull())
        .select(
            "event_id",
            *CALENDAR,
            F.col("m.movement_type").alias("movement_type"),
            F.col("m.port_name").alias("port_name"),
            "passenger_count",
            "vehicle_count",
        )
    )


def dim_port(port_day: DataFrame) -> DataFrame:
    """DIM1: per port, active days and lifetime sums."""
    return (
        port_day.where(F.col("port_name").isNotNull())
        .groupBy("port_name")
        .agg(
            F.count(F.lit(1)).alias("active_days"),
            F.sum("departure_record_count").alias("total_departure_records"),
            F.sum("arrival_record_count").alias("total_arrival_records"),
            F.sum("total_departing_passengers").alias("total_departing_passengers"),
            F.sum("total_arriving_passengers").alias("total_arriving_passengers"),
            F.sum("total_departing_vehicles").alias("total_departing_vehicles"),
            F.sum("total_arriving_vehicles").alias("total_arriving_vehicles"),
        )
    )


def dim_route(rec: DataFrame) -> DataFrame:
    """DIM2: per itinerary, attributes, distinct corridors, multi-stop flag."""
    pair = F.concat(F.coalesce("departure_port", F.lit("")), F.lit("|"), F.coalesce("arrival_port", F.lit("")))
    return (
        rec.groupBy("route_key")
        .agg(
            F.max("route_code").alias("route_code"),
            F.max("route_name").alias("route_name"),
            F.countDistinct(pair).alias("distinct_route_pairs"),
        )
        .withColumn("is_multi_stop_route", F.coalesce(F.col("route_name").like("%-%-%"), F.lit(False)))
    )


def dim_route_pair(rec: DataFrame) -> DataFrame:
    """DIM3: per (pair key, route key), attributes and record count."""
    return rec.groupBy("route_pair_key", "route_key").agg(
        F.max("route_code").alias("route_code"),
        F.max("route_name").alias("route_name"),
        F.max("departure_port").alias("departure_port"),
        F.max("arrival_port").alias("arrival_port"),
        F.count(F.lit(1)).alias("traffic_record_count"),
    )


def fct_route_daily(route_day: DataFrame) -> DataFrame:
    """FCT1: route-day without the calendar columns."""
    return route_day.select(
        "service_date",
        *ROUTE_ATTRS,
        "traffic_record_count",
        "total_passengers",
        "total_vehicles",
        "avg_passengers_per_record",
        "avg_vehicles_per_record",
    )


def _route_period(route_daily: DataFrame, period, name: str) -> DataFrame:
    agg = route_daily.groupBy(period.alias(name), *ROUTE_ATTRS).agg(
        F.sum("traffic_record_count").alias("traffic_record_count"),
        F.coalesce(F.sum("total_passengers"), F.lit(0)).cast("long").alias("total_passengers"),
        F.coalesce(F.sum("total_vehicles"), F.lit(0)).cast("long").alias("total_vehicles"),
    )
    # Period averages divide by all records (the daily one by non-null counts).
    return agg.withColumn(
        "avg_passengers_per_record", round_ratio("total_passengers", "traffic_record_count")
    ).withColumn("avg_vehicles_per_record", round_ratio("total_vehicles", "traffic_record_count"))


def fct_route_weekly(route_daily: DataFrame) -> DataFrame:
    """FCT2: Monday week × route attributes."""
    return _route_period(route_daily, week_start(F.col("service_date")), "week_start")


def fct_route_monthly(route_daily: DataFrame) -> DataFrame:
    """FCT3: month × route attributes (``year_month`` is the month's first day)."""
    return _route_period(route_daily, month_start(F.col("service_date")), "year_month")


def fct_port_daily(port_day: DataFrame) -> DataFrame:
    """FCT4: port-day facts."""
    return port_day.select("service_date", "port_name", *PORT_MEASURES)


def route_period_of_days(route_day: DataFrame, grain: str, directory: str | None = None, tasks: int = 0) -> DataFrame:
    """FCT2 or FCT3 (``grain`` week or month) from route-day rows whose keys are those of their other columns.

    The same rows as from the daily fact, grouped by what the keys are made
    of: no key is shuffled. With ``directory`` (a span of the calendar, as
    ``trunc`` names it) the groups are dealt into cells of directories over
    ``tasks``, as a write wants them, by the one shuffle that they need.
    """
    name, start = {"week": ("week_start", week_start), "month": ("year_month", month_start)}[grain]
    keys = [name, *ROUTE_DAY_BASE[1:]]
    days = tell_nameless(route_day).select(
        start(F.col("service_date")).alias(name), *ROUTE_DAY_BASE[1:], "traffic_record_count", "total_passengers", "total_vehicles")
    if directory:
        days = in_cells(days.withColumn("_span", F.trunc(name, directory)), "_span", keys, tasks)
        keys = ["_span", CELL, *keys]
    sums = days.groupBy(*keys).agg(
        F.sum("traffic_record_count").alias("traffic_record_count"),
        F.coalesce(F.sum("total_passengers"), F.lit(0)).cast("long").alias("total_passengers"),
        F.coalesce(F.sum("total_vehicles"), F.lit(0)).cast("long").alias("total_vehicles"),
    )
    code, dep, arr = (F.col(c) for c in ("route_code", "departure_port", "arrival_port"))
    own = F.when(~F.col("nameless"), F.col("route_name"))
    made = {
        "route_key": route_key(code, own, dep, arr), "route_pair_key": route_pair_key(code, own, dep, arr),
        "avg_passengers_per_record": round_ratio("total_passengers", "traffic_record_count"),
        "avg_vehicles_per_record": round_ratio("total_vehicles", "traffic_record_count"),
    }
    return sums.withColumns(made).select(
        name, *ROUTE_ATTRS, "traffic_record_count", "total_passengers", "total_vehicles", "avg_passengers_per_record", "avg_vehicles_per_record")


def _port_period(port_daily: DataFrame, period, name: str) -> DataFrame:
    return port_daily.groupBy(period.alias(name), "port_name").agg(
        *[F.sum(m).alias(m) for m in PORT_MEASURES]
    )


def fct_port_weekly(port_daily: DataFrame) -> DataFrame:
    """FCT5."""
    return _port_period(port_daily, week_start(F.col("service_date")), "week_start")


def fct_port_monthly(port_daily: DataFrame) -> DataFrame:
    """FCT6."""
    return _port_period(port_daily, month_start(F.col("service_date")), "year_month")


GRAIN_COLUMNS = {
    "daily": ("service_date", "service_date"),
    "weekly": ("service_week_start", "week_start"),
    "monthly": ("service_month_start", "year_month"),
    "yearly": ("service_year", "year"),
}


def port_day_from_route_day(route_day: DataFrame) -> DataFrame:
    """INT3 from the route-day grain (exact: every record sits in one route-day group).

    Each route-day row counts once for its departure port and once for its
    arrival port; NULL ports drop out as movements without a port do.
    """
    sides = F.array(
        F.struct(F.lit(True).alias("is_dep"), F.col("departure_port").alias("port_name")),
        F.struct(F.lit(False).alias("is_dep"), F.col("arrival_port").alias("port_name")),
    )
    x = route_day.select(*CALENDAR, "traffic_record_count", "total_passengers", "total_vehicles",
                         F.explode(sides).alias("s")).where(F.col("s.port_name").isNotNull())

    def side(is_dep: bool, c: str):
        cond = F.col("s.is_dep") if is_dep else ~F.col("s.is_dep")
        return F.coalesce(F.sum(F.when(cond, F.col(c)).otherwise(F.lit(0))), F.lit(0)).cast("long")

    return x.groupBy(*CALENDAR, F.col("s.port_name").alias("port_name")).agg(
        side(True, "traffic_record_count").alias("departure_record_count"),
        side(False, "traffic_record_count").alias("arrival_record_count"),
        side(True, "total_passengers").alias("total_departing_passengers"),
        side(False, "total_passengers").alias("total_arriving_passengers"),
        side(True, "total_vehicles").alias("total_departing_vehicles"),
        side(False, "total_vehicles").alias("total_arriving_vehicles"),
    )


def row_counts_from_route_day(route_day: DataFrame, grain: str) -> DataFrame:
    """RPT1–4 from the route-day grain.

    Exact: route key, pair key and both ports are grouping columns of the
    route-day rows, so their distinct count within a period is the same over
    route-day rows as over records; counts and sums add up.
    """
    src, name = GRAIN_COLUMNS[grain]
    return route_day.groupBy(F.col(src).alias(name)).agg(
        F.sum("traffic_record_count").cast("long").alias("rows_count"),
        F.countDistinct("route_key").alias("distinct_itineraries"),
        F.countDistinct("route_pair_key").alias("distinct_route_pairs"),
        F.countDistinct("departure_port").alias("distinct_departure_ports"),
        F.countDistinct("arrival_port").alias("distinct_arrival_ports"),
        F.coalesce(F.sum("total_passengers"), F.lit(0)).cast("long").alias("total_passengers"),
        F.coalesce(F.sum("total_vehicles"), F.lit(0)).cast("long").alias("total_vehicles"),
    )
