"""Deterministic snapshot rows (the SQL insight model).

Scope = the last 90 days with data (end = newest day, start = end − 89,
not before the first day). The scope bounds are ONE scalar subquery; the
facts are filtered with it on the day column and, when the facts live in a
month-partitioned warehouse, on the month column too, so the scan prunes
partitions. The one-row parts (totals, trend, leaders, digest) are global
aggregates, combined as scalar subqueries — no join against the one-row
scope, no cross join.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portflow.functions.fmt import py_fixed, signed_pct
from portflow.functions.keys import pair_label

SCOPE_DAYS = 90
# Fixed value: the "now" used when none is given (keeps tests repeatable).
DEFAULT_NOW = _dt.datetime(2026, 1, 3, 0, 0, 0)

SNAPSHOT_COLUMNS = [
    "snapshot_ts", "chart_id", "insight_type", "grain", "filter_hash", "data_version", "title", "summary", "facts",
    "anomalies", "comparisons", "recommendations", "report_text", "insight_text", "generation_mode",
    "generation_error", "model_name", "source_snapshot_json", "overlay_json",
]


def scope_bounds(daily: DataFrame) -> Column:
    """SNP1 as a scalar struct(start_date, end_date)."""
    d = F.col("service_date")
    return daily.agg(
        F.struct(
            F.greatest(F.date_sub(F.max(d), SCOPE_DAYS - 1), F.min(d)).alias("start_date"),
            F.max(d).alias("end_date"),
        )
    ).scalar()


def snap_scope(daily: DataFrame) -> DataFrame:
    """SNP1."""
    d = F.col("service_date")
    return daily.agg(
        F.greatest(F.date_sub(F.max(d), SCOPE_DAYS - 1), F.min(d)).alias("start_date"), F.max(d).alias("end_date")
    )


def in_scope(df: DataFrame, scope: Column, col: str = "service_date", month_col: str | None = None) -> DataFrame:
    """SNP2: rows inside the scope; also on the partition column when there is one."""
    s, e = scope.getField("start_date"), scope.getField("end_date")
    out = df.where(F.col(col).between(s, e))
    if month_col is not None:
        out = out.where(F.col(month_col).between(F.trunc(s, "month"), F.trunc(e, "month")))
    return out


def snap_totals(daily_scope: DataFrame, scope: Column) -> DataFrame:
    """SNP3: one row even for an empty scope."""
    return daily_scope.agg(
        F.coalesce(F.sum("rows_count"), F.lit(0)).cast("long").alias("rows_total"),
        F.coalesce(F.sum("total_passengers"), F.lit(0)).cast("long").alias("passengers_total"),
        F.coalesce(F.sum("total_vehicles"), F.lit(0)).cast("long").alias("vehicles_total"),
    ).select(scope.getField("start_date").alias("start_date"), scope.getField("end_date").alias("end_date"), "*")


def _by_recency(daily_scope: DataFrame) -> DataFrame:
    # Day grain (≤ 90 rows in scope): a global ordering window is fine.
    from pyspark.sql import Window

    return daily_scope.withColumn("rn", F.row_number().over(Window.orderBy(F.col("service_date").desc())))


def snap_trend(daily_scope: DataFrame) -> DataFrame:
    """SNP4: mean passengers of the 7 newest day rows and of rows 8..14."""
    r = _by_recency(daily_scope)
    p = F.col("total_passengers").cast("double")
    return r.agg(
        F.coalesce(F.avg(F.when(F.col("rn") <= 7, p)), F.lit(0.0)).alias("recent_avg_passengers"),
        F.coalesce(F.avg(F.when(F.col("rn").between(8, 14), p)), F.lit(0.0)).alias("prior_avg_passengers"),
    )


def snap_corridors(route_scope: DataFrame) -> DataFrame:
    """SNP5: corridor totals by label (NULL ends → 'Unknown')."""
    return route_scope.groupBy(pair_label(F.col("departure_port"), F.col("arrival_port")).alias("pair_label")).agg(
        F.sum("total_passengers").alias("passengers"), F.sum("traffic_record_count").alias("sailings")
    )


def snap_top_corridor(corridors: DataFrame) -> DataFrame:
    """SNP6: top corridor by passengers, sailings (label as last tie-break)."""
    return corridors.orderBy(F.col("passengers").desc(), F.col("sailings").desc(), F.col("pair_label").asc()).limit(1)


def snap_route_digest(corridors: DataFrame) -> DataFrame:
    """SNP7: sha256 of the top-5 ``label:passengers`` joined by '|', 16 hex; 'none' if empty."""
    top5 = corridors.orderBy(F.col("passengers").desc(), F.col("pair_label").asc()).limit(5)
    item = F.struct(
        (-F.col("passengers")).alias("k1"), F.col("pair_label").alias("k2"),
        F.concat(F.col("pair_label"), F.lit(":"), F.col("passengers").cast("long").cast("string")).alias("s"),
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["s"]), "|")
    return top5.agg(
        F.when(F.count(F.lit(1)) > 0, F.substring(F.sha2(joined, 256), 1, 16)).otherwise(F.lit("none")).alias("top_routes_hash")
    )


def snap_port_totals(port_scope: DataFrame) -> DataFrame:
    return port_scope.groupBy("port_name").agg(
        F.sum(F.col("total_departing_passengers") + F.col("total_arriving_passengers")).alias("passengers")
    )


def snap_top_port(port_scope: DataFrame) -> DataFrame:
    """SNP8: busiest port (departing + arriving passengers), name as tie-break."""
    return snap_port_totals(port_scope).orderBy(F.col("passengers").desc(), F.col("port_name").asc()).limit(1)


def snap_base(daily: DataFrame, route_daily: DataFrame, port_daily: DataFrame, month_col: str | None = None) -> DataFrame:
    """SNP9 + the one base row every snapshot row is formatted from.

    ``month_col``: the month column of ``route_daily``, if it is partitioned by it (days and ports are small tables).
    """
    scope = scope_bounds(daily)
    ds = in_scope(daily, scope)
    corridors = snap_corridors(in_scope(route_daily, scope, month_col=month_col))
    totals = snap_totals(ds, scope)
    trend = snap_trend(ds).select(F.struct("*")).scalar()
    tc = snap_top_corridor(corridors).agg(
        F.struct(F.first("pair_label").alias("label"), F.first("passengers").alias("passengers"),
                 F.first("sailings").alias("sailings"))
    ).scalar()
    digest = snap_route_digest(corridors).scalar()
    tp = snap_top_port(in_scope(port_daily, scope)).agg(
        F.struct(F.first("port_name").alias("port_name"), F.first("passengers").alias("passengers"))
    ).scalar()
    return totals.select(
        "start_date", "end_date", "rows_total", "passengers_total", "vehicles_total",
        trend.getField("recent_avg_passengers").alias("recent_avg_passengers"),
        trend.getField("prior_avg_passengers").alias("prior_avg_passengers"),
        F.coalesce(tc.getField("label"), F.lit("No data")).alias("top_corridor_label"),
        F.coalesce(tc.getField("passengers"), F.lit(0)).cast("long").alias("top_corridor_passengers"),
        F.coalesce(tc.getField("sailings"), F.lit(0)).cast("long").alias("top_corridor_sailings"),
        F.coalesce(tp.getField("port_name"), F.lit("No data")).alias("top_port_name"),
        F.coalesce(tp.getField("passengers"), F.lit(0)).cast("long").alias("top_port_passengers"),
        F.concat(
            F.col("end_date").cast("string"), F.lit("|rows:"), F.col("rows_total").cast("string"),
            F.lit("|pax:"), F.col("passengers_total").cast("string"), F.lit("|top:"), F.coalesce(digest, F.lit("none")),
        ).alias("data_version"),
    )


def _int(c: str) -> Column:
    """CAST(x AS INT64) of the warehouse: round half away from zero."""
    return F.round(F.col(c).cast("double"), 0).cast("long").cast("string")


def _share(num: str) -> Column:
    return F.when(F.col("passengers_total") > 0,
                  F.col(num).cast("double") / F.col("passengers_total").cast("double") * 100.0).otherwise(F.lit(0.0))


def snap_deepen_rows(base: DataFrame, snapshot_ts: Column | None = None) -> DataFrame:
    """SNP10: three deepen-chart rows (traffic_pulse, top_corridors, port_balance) from one base row."""
    ts = snapshot_ts if snapshot_ts is not None else F.lit(DEFAULT_NOW).cast("timestamp_ntz")
    recent, prior = _int("recent_avg_passengers"), _int("prior_avg_passengers")
    pax, veh = _int("passengers_total"), _int("vehicles_total")
    tcp, tcs, tpp = _int("top_corridor_passengers"), _int("top_corridor_sailings"), _int("top_port_passengers")
    label, port = F.col("top_corridor_label"), F.col("top_port_name")
    delta = (F.col("recent_avg_passengers") - F.col("prior_avg_passengers")) / F.col("prior_avg_passengers") * 100.0
    null_s = F.lit(None).cast("string")

    def row(chart, title, summary, facts, anomalies, comparisons, recommendation, report):
        return base.select(
            ts.alias("snapshot_ts"), F.lit(chart).alias("chart_id"), F.lit("deepen_chart").alias("insight_type"),
            F.lit("weekly").alias("grain"), null_s.alias("filter_hash"), "data_version", F.lit(title).alias("title"),
            summary.alias("summary"), F.array(*facts).alias("facts"), F.array(*anomalies).alias("anomalies"),
            F.array(*comparisons).alias("comparisons"), F.array(F.lit(recommendation)).alias("recommendations"),
            report.alias("report_text"), null_s.alias("insight_text"), F.lit("deterministic_sql").alias("generation_mode"),
            null_s.alias("generation_error"), null_s.alias("model_name"), null_s.alias("source_snapshot_json"),
            null_s.alias("overlay_json"),
        )

    pulse = row(
        "traffic_pulse", "Traffic Pulse Insight",
        F.concat(F.lit("Recent 7-day passenger average is "), recent, F.lit(" versus prior "), prior, F.lit(", indicating "),
                 F.when(F.col("recent_avg_passengers") >= F.col("prior_avg_passengers"), F.lit("upward")).otherwise(F.lit("downward")),
                 F.lit(" momentum.")),
        [F.concat(F.lit("Recent 7-day average: "), recent, F.lit(" passengers/day.")),
         F.concat(F.lit("Prior 7-day average: "), prior, F.lit(" passengers/day."))],
        [F.when(F.col("prior_avg_passengers") > 0,
                F.concat(F.lit("Delta vs prior 7-day window: "), signed_pct(delta, 1), F.lit(".")))
         .otherwise(F.lit("Insufficient prior window for delta."))],
        [F.concat(F.lit("Window total passengers: "), pax, F.lit(".")),
         F.concat(F.lit("Window total vehicles: "), veh, F.lit("."))],
        "Investigate major day-over-day swings against route concentration changes.",
        F.concat(F.lit("Trend check: recent 7-day average "), recent, F.lit(" vs prior "), prior, F.lit(".")),
    )
    corridors = row(
        "top_corridors", "Top Corridors Insight",
        F.concat(F.lit("Leading corridor is "), label, F.lit(" with "), tcp, F.lit(" passengers and "), tcs,
                 F.lit(" sailings in scope.")),
        [F.concat(F.lit("Top corridor: "), label, F.lit(".")),
         F.concat(F.lit("Top corridor passengers: "), tcp, F.lit(".")),
         F.concat(F.lit("Top corridor sailings: "), tcs, F.lit("."))],
        [F.concat(F.lit("Top corridor share: "), py_fixed(_share("top_corridor_passengers"), 1), F.lit("% of total passengers."))],
        [F.concat(F.lit("Total window passengers: "), pax, F.lit("."))],
        "Watch for concentration spikes that increase network dependency on one corridor.",
        F.concat(F.lit("Corridor concentration summary: "), label, F.lit(" leads with "), tcp, F.lit(" passengers.")),
    )
    ports = row(
        "port_balance", "Port Balance Insight",
        F.concat(F.lit("Highest passenger flow port is "), port, F.lit(" with "), tpp, F.lit(" passengers in the current window.")),
        [F.concat(F.lit("Top port: "), port, F.lit(".")), F.concat(F.lit("Top port passengers: "), tpp, F.lit("."))],
        [F.concat(F.lit("Top port share of total passengers: "), py_fixed(_share("top_port_passengers"), 1), F.lit("%."))],
        [F.concat(F.lit("Total portscope passengers in window: "), pax, F.lit("."))],
        "Review weekday imbalance at the leading port and monitor abrupt inflow/outflow changes.",
        F.concat(F.lit("Port focus summary: "), port, F.lit(" leads at "), tpp, F.lit(" passengers.")),
    )
    return reduce(DataFrame.unionByName, [pulse, corridors, ports])


def intelligence_snapshots(daily: DataFrame, route_daily: DataFrame, port_daily: DataFrame,
                           snapshot_ts: Column | None = None, month_col: str | None = None) -> DataFrame:
    """The whole SQL snapshot model: base row → three deepen-chart rows."""
    return snap_deepen_rows(snap_base(daily, route_daily, port_daily, month_col), snapshot_ts)
