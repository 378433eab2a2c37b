"""Registered ad-hoc catalogue queries (ADH1–ADH13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from portflow.operators import adhoc as A
from portflow.plans.models import TrafficModels
from portflow.plans.oracle_base import with_ctes
from portflow.plans.registry import register
from portflow.sources.testdata import star_records


def _m(spark, sf_dir):
    return TrafficModels(spark, sf_dir)


_COUNT_TABLES = {
    "raw_sailing_traffic": ("raw", "raw"),
    "stg_sailing_traffic": ("stg", "stg"),
    "row_counts_daily": ("row_counts_daily", "row_counts_daily"),
    "row_counts_weekly": ("row_counts_weekly", "row_counts_weekly"),
    "fct_route_traffic_daily": ("fct_route_daily", "fct_route_daily"),
    "fct_port_activity_daily": ("fct_port_daily", "fct_port_daily"),
}


@register(
    "table_counts",
    with_ctes(
        " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {c}" for t, (_, c) in _COUNT_TABLES.items()),
        *[c for _, c in _COUNT_TABLES.values()],
    ),
)
def q_table_counts(spark, sf_dir):
    m = _m(spark, sf_dir)
    return A.table_counts({t: getattr(m, a) for t, (a, _) in _COUNT_TABLES.items()})


_RAW_COLS = "record_hash, service_date, route_code, route_name, departure_port, arrival_port, passenger_count, vehicle_count, ingested_at"


@register("sample_raw", with_ctes(f"SELECT {_RAW_COLS} FROM raw ORDER BY record_hash, ingested_at LIMIT 10", "raw"))
def q_sample_raw(spark, sf_dir):
    raw = _m(spark, sf_dir).raw.drop("raw_payload")
    return A.sample_rows(raw, [F.col("record_hash"), F.col("ingested_at")])


@register(
    "sample_stg",
    with_ctes("SELECT * EXCLUDE (raw_payload) FROM stg ORDER BY record_hash, ingested_at LIMIT 10", "stg"),
)
def q_sample_stg(spark, sf_dir):
    return A.sample_rows(_m(spark, sf_dir).stg.drop("raw_payload"), [F.col("record_hash"), F.col("ingested_at")])


@register(
    "sample_route_daily",
    with_ctes(
        "SELECT * FROM fct_route_daily ORDER BY service_date, route_pair_key, route_name, route_code NULLS FIRST LIMIT 10",
        "fct_route_daily",
    ),
)
def q_sample_route_daily(spark, sf_dir):
    return A.sample_rows(
        _m(spark, sf_dir).fct_route_daily,
        [F.col("service_date"), F.col("route_pair_key"), F.col("route_name"), F.col("route_code").asc_nulls_first()],
    )


@register("sample_port_daily", with_ctes("SELECT * FROM fct_port_daily ORDER BY service_date, port_name LIMIT 10", "fct_port_daily"))
def q_sample_port_daily(spark, sf_dir):
    return A.sample_rows(_m(spark, sf_dir).fct_port_daily, [F.col("service_date"), F.col("port_name")])


@register("stg_date_range", with_ctes("SELECT MIN(service_date) AS min_date, MAX(service_date) AS max_date FROM stg", "stg"))
def q_stg_date_range(spark, sf_dir):
    return A.date_range(_m(spark, sf_dir).stg)


@register(
    "totals_by_grain",
    with_ctes(
        "SELECT 'daily' AS grain, service_date AS period_start, rows_count, total_passengers, total_vehicles FROM row_counts_daily "
        "UNION ALL SELECT 'weekly', week_start, rows_count, total_passengers, total_vehicles FROM row_counts_weekly "
        "UNION ALL SELECT 'monthly', year_month, rows_count, total_passengers, total_vehicles FROM row_counts_monthly",
        "row_counts_daily", "row_counts_weekly", "row_counts_monthly",
    ),
)
def q_totals_by_grain(spark, sf_dir):
    m = _m(spark, sf_dir)
    return A.totals_by_grain(m.row_counts_daily, m.row_counts_weekly, m.row_counts_monthly)


def _top_routes_sql(by: str) -> str:
    return with_ctes(
        "SELECT route_name, CAST(SUM(total_passengers) AS BIGINT) AS passengers, CAST(SUM(total_vehicles) AS BIGINT) AS vehicles, "
        f"CAST(SUM(traffic_record_count) AS BIGINT) AS sailings FROM fct_route_daily GROUP BY route_name "
        f"ORDER BY {by} DESC, route_name NULLS FIRST LIMIT 10",
        "fct_route_daily",
    )


@register("top_routes_pax", _top_routes_sql("passengers"))
def q_top_routes_pax(spark, sf_dir):
    return A.top_routes(_m(spark, sf_dir).fct_route_daily, "passengers")


@register("top_routes_veh", _top_routes_sql("vehicles"))
def q_top_routes_veh(spark, sf_dir):
    return A.top_routes(_m(spark, sf_dir).fct_route_daily, "vehicles")


def _top_ports_sql(by: str) -> str:
    return with_ctes(
        "SELECT port_name, CAST(SUM(departure_record_count) AS BIGINT) AS departures, "
        "CAST(SUM(arrival_record_count) AS BIGINT) AS arrivals FROM fct_port_daily GROUP BY port_name "
        f"ORDER BY {by} DESC, port_name NULLS FIRST LIMIT 10",
        "fct_port_daily",
    )


@register("top_ports_dep", _top_ports_sql("departures"))
def q_top_ports_dep(spark, sf_dir):
    return A.top_ports(_m(spark, sf_dir).fct_port_daily, "departures")


@register("top_ports_arr", _top_ports_sql("arrivals"))
def q_top_ports_arr(spark, sf_dir):
    return A.top_ports(_m(spark, sf_dir).fct_port_daily, "arrivals")


@register(
    "top_pairs_stg",
    with_ctes(
        "SELECT departure_port, arrival_port, COUNT(*) AS route_events, CAST(SUM(passenger_count) AS BIGINT) AS passengers, "
        "CAST(SUM(vehicle_count) AS BIGINT) AS vehicles FROM stg GROUP BY ALL "
        "ORDER BY passengers DESC NULLS LAST, departure_port NULLS FIRST, arrival_port NULLS FIRST LIMIT 10",
        "stg",
    ),
)
def q_top_pairs_stg(spark, sf_dir):
    return A.top_pairs(_m(spark, sf_dir).stg)


@register(
    "avg_load_per_route",
    with_ctes(
        "SELECT route_name, "
        "CAST(SUM(CAST(round(avg_passengers_per_record * 100) AS BIGINT)) AS DOUBLE) / CAST(COUNT(avg_passengers_per_record) * 100 AS DOUBLE) AS avg_passengers_per_sailing, "
        "CAST(SUM(CAST(round(avg_vehicles_per_record * 100) AS BIGINT)) AS DOUBLE) / CAST(COUNT(avg_vehicles_per_record) * 100 AS DOUBLE) AS avg_vehicles_per_sailing, "
        "CAST(SUM(traffic_record_count) AS BIGINT) AS sailings FROM fct_route_daily GROUP BY route_name "
        "ORDER BY avg_passengers_per_sailing DESC, route_name NULLS FIRST LIMIT 10",
        "fct_route_daily",
    ),
)
def q_avg_load_per_route(spark, sf_dir):
    return A.avg_load_per_route(_m(spark, sf_dir).fct_route_daily)


@register(
    "recent_weeks",
    with_ctes("SELECT week_start, total_passengers, total_vehicles FROM row_counts_weekly ORDER BY week_start DESC LIMIT 20", "row_counts_weekly"),
)
def q_recent_weeks(spark, sf_dir):
    return A.recent_weeks(_m(spark, sf_dir).row_counts_weekly)


@register(
    "one_week",
    with_ctes(
        "SELECT week_start, total_passengers, total_vehicles FROM row_counts_weekly "
        "WHERE week_start = (SELECT MAX(week_start) FROM row_counts_weekly)",
        "row_counts_weekly",
    ),
)
def q_one_week(spark, sf_dir):
    """ADH9 point lookup; the week is the newest one (a scalar subquery)."""
    w = _m(spark, sf_dir).row_counts_weekly
    return A.one_week(w, w.agg(F.max("week_start")).scalar())


@register(
    "top_route_weeks",
    with_ctes(
        "SELECT week_start, route_name, total_passengers, total_vehicles, traffic_record_count FROM fct_route_weekly "
        "ORDER BY total_passengers DESC, week_start, route_pair_key, route_name LIMIT 20",
        "fct_route_weekly",
    ),
)
def q_top_route_weeks(spark, sf_dir):
    return A.top_route_weeks(_m(spark, sf_dir).fct_route_weekly)


@register(
    "top_port_weeks",
    with_ctes(
        "SELECT week_start, port_name, departure_record_count, arrival_record_count, total_departing_passengers, "
        "total_arriving_passengers FROM fct_port_weekly ORDER BY departure_record_count DESC, week_start, port_name LIMIT 20",
        "fct_port_weekly",
    ),
)
def q_top_port_weeks(spark, sf_dir):
    return A.top_port_weeks(_m(spark, sf_dir).fct_port_weekly)


@register(
    "sanity_totals",
    with_ctes(
        "SELECT MAX(service_date) AS latest_service_date, CAST(SUM(total_passengers) AS BIGINT) AS passengers, "
        "CAST(SUM(total_vehicles) AS BIGINT) AS vehicles FROM row_counts_daily",
        "row_counts_daily",
    ),
)
def q_sanity_totals(spark, sf_dir):
    return A.sanity_totals(_m(spark, sf_dir).row_counts_daily)


@register(
    "explore_routes",
    with_ctes(
        "SELECT routecode, routecodenames, CAST(SUM(passengercount) AS BIGINT) AS passengercount, "
        "CAST(SUM(vehiclecount) AS BIGINT) AS vehiclecount FROM src GROUP BY ALL "
        "ORDER BY passengercount DESC, routecode NULLS FIRST, routecodenames NULLS FIRST LIMIT 10",
        "src",
    ),
)
def q_explore_routes(spark, sf_dir):
    return A.explore_routes(star_records(spark, sf_dir))


@register(
    "explore_ports",
    with_ctes(
        "SELECT departureportname, CAST(SUM(passengercount) AS BIGINT) AS passengercount, "
        "CAST(SUM(vehiclecount) AS BIGINT) AS vehiclecount FROM src GROUP BY ALL "
        "ORDER BY passengercount DESC, departureportname NULLS FIRST LIMIT 10",
        "src",
    ),
)
def q_explore_ports(spark, sf_dir):
    return A.explore_ports(star_records(spark, sf_dir))


@register(
    "explore_daily",
    with_ctes(
        "SELECT CAST(date AS DATE) AS date, CAST(SUM(passengercount) AS BIGINT) AS passengercount, "
        "CAST(SUM(vehiclecount) AS BIGINT) AS vehiclecount FROM src GROUP BY 1",
        "src",
    ),
)
def q_explore_daily(spark, sf_dir):
    return A.explore_daily(star_records(spark, sf_dir))


@register(
    "top_route_days",
    with_ctes(
        "SELECT * FROM fct_route_daily ORDER BY total_passengers DESC, service_date, route_pair_key, route_name LIMIT 20",
        "fct_route_daily",
    ),
)
def q_top_route_days(spark, sf_dir):
    return A.top_route_days(_m(spark, sf_dir).fct_route_daily)


@register(
    "top_port_days",
    with_ctes(
        "SELECT * FROM fct_port_daily ORDER BY departure_record_count DESC, arrival_record_count DESC, service_date, port_name LIMIT 20",
        "fct_port_daily",
    ),
)
def q_top_port_days(spark, sf_dir):
    return A.top_port_days(_m(spark, sf_dir).fct_port_daily)
