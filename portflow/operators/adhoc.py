"""Ad-hoc query catalogue over the warehouse tables.

Every ``limit`` here is the feature (a top-k report or a sample) and every
ordering ends in a unique tie-break so the k rows are deterministic. Top-k
plans as ``TakeOrderedAndProject``: each task keeps its local k rows, only
k × tasks rows reach the final merge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """ADH1: row count of each named table (one aggregate per table, unioned)."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def sample_rows(df: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    """ADH2: the first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)


def date_range(df: DataFrame, col: str = "service_date") -> DataFrame:
    """ADH3."""
    return df.agg(F.min(col).alias("min_date"), F.max(col).alias("max_date"))


def totals_by_grain(daily: DataFrame, weekly: DataFrame, monthly: DataFrame) -> DataFrame:
    """ADH4: daily, weekly and monthly totals in one long table."""
    cols = ["rows_count", "total_passengers", "total_vehicles"]
    return reduce(
        DataFrame.unionByName,
        [
            daily.select(F.lit("daily").alias("grain"), F.col("service_date").alias("period_start"), *cols),
            weekly.select(F.lit("weekly").alias("grain"), F.col("week_start").alias("period_start"), *cols),
            monthly.select(F.lit("monthly").alias("grain"), F.col("year_month").alias("period_start"), *cols),
        ],
    )


def top_routes(route_daily: DataFrame, by: str = "passengers", n: int = 10) -> DataFrame:
    """ADH5: routes by passengers or vehicles."""
    agg = route_daily.groupBy("route_name").agg(
        F.sum("total_passengers").alias("passengers"),
        F.sum("total_vehicles").alias("vehicles"),
        F.sum("traffic_record_count").alias("sailings"),
    )
    return agg.orderBy(F.col(by).desc(), F.col("route_name").asc_nulls_first()).limit(n)


def top_ports(port_daily: DataFrame, by: str = "departures", n: int = 10) -> DataFrame:
    """ADH6: ports by departure or arrival records."""
    agg = port_daily.groupBy("port_name").agg(
        F.sum("departure_record_count").alias("departures"),
        F.sum("arrival_record_count").alias("arrivals"),
    )
    return agg.orderBy(F.col(by).desc(), F.col("port_name").asc_nulls_first()).limit(n)


def top_pairs(stg: DataFrame, n: int = 10) -> DataFrame:
    """ADH7: departure–arrival pairs by passengers, before dedup."""
    agg = stg.groupBy("departure_port", "arrival_port").agg(
        F.count(F.lit(1)).alias("route_events"),
        F.sum("passenger_count").alias("passengers"),
        F.sum("vehicle_count").alias("vehicles"),
    )
    return agg.orderBy(
        F.col("passengers").desc_nulls_last(), F.col("departure_port").asc_nulls_first(),
        F.col("arrival_port").asc_nulls_first(),
    ).limit(n)


def exact_mean_2dp(c: str) -> Column:
    """Mean of values that carry two decimals, computed on the exact integers."""
    return F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / (F.count(c) * 100).cast("double")


def avg_load_per_route(route_daily: DataFrame, n: int = 10) -> DataFrame:
    """ADH8: unweighted mean of the daily averages per route."""
    agg = route_daily.groupBy("route_name").agg(
        exact_mean_2dp("avg_passengers_per_record").alias("avg_passengers_per_sailing"),
        exact_mean_2dp("avg_vehicles_per_record").alias("avg_vehicles_per_sailing"),
        F.sum("traffic_record_count").alias("sailings"),
    )
    return agg.orderBy(F.col("avg_passengers_per_sailing").desc(), F.col("route_name").asc_nulls_first()).limit(n)


def recent_weeks(weekly: DataFrame, n: int = 20) -> DataFrame:
    """ADH9: newest weekly totals."""
    return weekly.select("week_start", "total_passengers", "total_vehicles").orderBy(F.col("week_start").desc()).limit(n)


def one_week(weekly: DataFrame, week: Column) -> DataFrame:
    """ADH9: the totals of one week (``week`` may be a literal or a scalar subquery)."""
    return weekly.where(F.col("week_start") == week).select("week_start", "total_passengers", "total_vehicles")


def top_route_weeks(route_weekly: DataFrame, n: int = 20) -> DataFrame:
    """ADH10."""
    return route_weekly.select(
        "week_start", "route_name", "total_passengers", "total_vehicles", "traffic_record_count", "route_pair_key"
    ).orderBy(
        F.col("total_passengers").desc(), F.col("week_start").asc(), F.col("route_pair_key").asc(),
        F.col("route_name").asc(),
    ).limit(n).drop("route_pair_key")


def top_port_weeks(port_weekly: DataFrame, n: int = 20) -> DataFrame:
    """ADH10."""
    return port_weekly.select(
        "week_start", "port_name", "departure_record_count", "arrival_record_count", "total_departing_passengers",
        "total_arriving_passengers",
    ).orderBy(F.col("departure_record_count").desc(), F.col("week_start").asc(), F.col("port_name").asc()).limit(n)


def sanity_totals(daily: DataFrame) -> DataFrame:
    """ADH11."""
    return daily.agg(
        F.max("service_date").alias("latest_service_date"),
        F.sum("total_passengers").alias("passengers"),
        F.sum("total_vehicles").alias("vehicles"),
    )


def explore_routes(src: DataFrame, n: int = 10) -> DataFrame:
    """ADH12: source fields, null groups kept."""
    agg = src.groupBy("routecode", "routecodenames").agg(
        F.sum("passengercount").alias("passengercount"), F.sum("vehiclecount").alias("vehiclecount")
    )
    return agg.orderBy(
        F.col("passengercount").desc(), F.col("routecode").asc_nulls_first(), F.col("routecodenames").asc_nulls_first()
    ).limit(n)


def explore_ports(src: DataFrame, n: int = 10) -> DataFrame:
    """ADH12."""
    agg = src.groupBy("departureportname").agg(
        F.sum("passengercount").alias("passengercount"), F.sum("vehiclecount").alias("vehiclecount")
    )
    return agg.orderBy(F.col("passengercount").desc(), F.col("departureportname").asc_nulls_first()).limit(n)


def explore_daily(src: DataFrame) -> DataFrame:
    """ADH12."""
    return src.groupBy(F.col("date").cast("date").alias("date")).agg(
        F.sum("passengercount").alias("passengercount"), F.sum("vehiclecount").alias("vehiclecount")
    )


def top_route_days(route_daily: DataFrame, n: int = 20) -> DataFrame:
    """ADH13."""
    return route_daily.orderBy(
        F.col("total_passengers").desc(), F.col("service_date").asc(), F.col("route_pair_key").asc(),
        F.col("route_name").asc(),
    ).limit(n)


def top_port_days(port_daily: DataFrame, n: int = 20) -> DataFrame:
    """ADH13 (ordered by the mart's record counts)."""
    return port_daily.orderBy(
        F.col("departure_record_count").desc(), F.col("arrival_record_count").desc(), F.col("service_date").asc(),
        F.col("port_name").asc(),
    ).limit(n)
