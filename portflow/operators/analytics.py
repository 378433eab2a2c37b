"""Dashboard analytics over the day-grain facts.

Inputs are the three day-grain frames of the analytics layer:

* ``daily``  — row_counts_daily (one row per day)
* ``routes`` — route facts per day (service_date, departure_port, arrival_port, counts)
* ``ports``  — port facts per day

A ``View`` is an inclusive date window whose bounds are Columns: literals,
or scalar subqueries over the data (evaluated once, then used as runtime
filter values that reach the scan). Nothing is collected to the driver.

Grain notes. Everything that ranks or smooths over time works on the day /
week / month grain (thousands of rows), never on records, so the few global
windows (``row_number`` over all ports, trailing means over periods) move a
small, bounded number of rows to one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portflow.functions.days import within_days
from portflow.functions.fmt import compact, fixed
from portflow.functions.keys import pair_label
from portflow.functions.numeric import safe_share

# Weekday abbreviations in display order.
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
# baseline = 8 windows of 7 days before the current 7 days.
BASELINE_WINDOWS = 8
WINDOW_DAYS = 7


@dataclass(frozen=True)
class View:
    start: Column
    end: Column
    # Newest day with data inside the view, when already known (saves a subquery).
    last_day: Column | None = None
    # The view covers every available day: filtering the day-grain frames is a no-op.
    full: bool = False

    def apply(self, df: DataFrame, col: str = "service_date") -> DataFrame:
        if self.full and col == "service_date":
            return df
        return within_days(df, self.start, self.end, col)


def bounds(daily: DataFrame) -> Column:
    """ONE scalar subquery: struct(mn, mx) of the available days."""
    return daily.agg(F.struct(F.min("service_date").alias("mn"), F.max("service_date").alias("mx"))).scalar()


def full_view(daily: DataFrame) -> View:
    """All available days."""
    b = bounds(daily)
    return View(b.getField("mn"), b.getField("mx"), b.getField("mx"), full=True)


def default_view(daily: DataFrame, days: int = 90) -> View:
    """Last ``days`` days ending at the newest day, not before the first."""
    b = bounds(daily)
    mx = b.getField("mx")
    return View(F.greatest(F.date_sub(mx, days - 1), b.getField("mn")), mx, mx)


def literal_view(start: str, end: str) -> View:
    return View(F.lit(start).cast("date"), F.lit(end).cast("date"))


# --- ANA1–ANA5: bounds, coverage, options, presets, refresh token -----------------

def date_bounds(daily: DataFrame) -> DataFrame:
    """ANA1."""
    return daily.agg(
        F.min("service_date").alias("min_date"),
        F.max("service_date").alias("max_date"),
        F.countDistinct("service_date").alias("days_available"),
    )


def _coverage_text(available: Column, expected: Column) -> Column:
    missing = expected - available
    return (
        F.when(expected <= 0, F.lit("No days in range"))
        .when(missing == 0, F.format_string("%d/%d days present", available, expected))
        .otherwise(F.format_string("%d/%d days present (%d missing)", available, expected, missing))
    )


def coverage(daily: DataFrame, view: View) -> DataFrame:
    """ANA2: available vs inclusive calendar days, for the dataset and for the view."""

    def one(scope: str, df: DataFrame, start: Column, end: Column) -> DataFrame:
        agg = df.agg(F.countDistinct("service_date").alias("n")).select(
            F.lit(scope).alias("scope"), start.alias("start_date"), end.alias("end_date"), "n"
        )
        expected = F.greatest(F.datediff("end_date", "start_date") + 1, F.lit(0))
        available = F.least(F.greatest(F.col("n"), F.lit(0)), expected)
        return agg.select(
            "scope", "start_date", "end_date",
            expected.cast("long").alias("expected_days"),
            available.cast("long").alias("available_days"),
            F.greatest(expected - available, F.lit(0)).cast("long").alias("missing_days"),
            _coverage_text(available, expected).alias("coverage_text"),
        )

    b = bounds(daily)
    mn, mx = b.getField("mn"), b.getField("mx")
    return one("dataset", daily, mn, mx).unionByName(one("view", view.apply(daily), view.start, view.end))


def corridor_options(routes: DataFrame) -> DataFrame:
    """ANA3: distinct corridors with both ends known."""
    return (
        routes.where(F.col("departure_port").isNotNull() & F.col("arrival_port").isNotNull())
        .select("departure_port", "arrival_port").distinct()
        .withColumn("corridor", pair_label(F.col("departure_port"), F.col("arrival_port")))
        .orderBy("departure_port", "arrival_port")
    )


def port_options(ports: DataFrame) -> DataFrame:
    """ANA3: distinct known ports."""
    return ports.where(F.col("port_name").isNotNull()).select("port_name").distinct().orderBy("port_name")


def preset_scope(daily: DataFrame, custom_start: Column | None = None, custom_end: Column | None = None) -> DataFrame:
    """ANA4: resolve the date presets, clamp to the data, swap a reversed pair."""
    b = daily.agg(F.min("service_date").alias("mn"), F.max("service_date").alias("mx"))
    mx, mn = F.col("mx"), F.col("mn")
    d90 = F.date_sub(mx, 89)
    cs = d90 if custom_start is None else custom_start
    ce = mx if custom_end is None else custom_end
    presets = F.array(
        F.struct(F.lit("Last 30D").alias("preset"), F.date_sub(mx, 29).alias("s"), mx.alias("e")),
        F.struct(F.lit("Last 90D").alias("preset"), d90.alias("s"), mx.alias("e")),
        F.struct(F.lit("YTD").alias("preset"), F.trunc(mx, "year").alias("s"), mx.alias("e")),
        F.struct(F.lit("Custom").alias("preset"), cs.alias("s"), ce.alias("e")),
    )
    p = b.select("mn", "mx", F.inline(presets))
    s = F.greatest(mn, F.least(F.col("s"), mx))
    e = F.greatest(mn, F.least(F.col("e"), mx))
    return p.select(
        "preset", F.least(s, e).alias("start_date"), F.greatest(s, e).alias("end_date"),
        (s > e).alias("swapped"),
    )


def refresh_token(daily: DataFrame) -> DataFrame:
    """ANA5 (fallback form): ``max date|row count|sum of rows``."""
    return daily.agg(
        F.concat_ws(
            "|",
            F.max("service_date").cast("string"),
            F.count(F.lit(1)).cast("string"),
            F.coalesce(F.sum("rows_count"), F.lit(0)).cast("string"),
        ).alias("data_token")
    )


# --- ANA6–ANA10: re-scoping and port flows ------------------------------------------

def scope_routes(routes: DataFrame, corridor: tuple[Column, Column] | None = None, port: Column | None = None) -> DataFrame:
    """ANA6: corridor equality, then port at either end."""
    out = routes
    if corridor is not None:
        out = out.where((F.col("departure_port") == corridor[0]) & (F.col("arrival_port") == corridor[1]))
    if port is not None:
        out = out.where((F.col("departure_port") == port) | (F.col("arrival_port") == port))
    return out


def daily_from_routes(routes: DataFrame) -> DataFrame:
    """ANA7: daily totals rebuilt from route rows."""
    return routes.groupBy("service_date").agg(
        F.sum("traffic_record_count").alias("rows_count"),
        F.countDistinct(pair_label(F.col("departure_port"), F.col("arrival_port"))).alias("distinct_route_pairs"),
        F.sum("total_passengers").alias("total_passengers"),
        F.sum("total_vehicles").alias("total_vehicles"),
    )


def _sides(routes: DataFrame, *keep: str) -> DataFrame:
    """Each route row once from its departure and once from its arrival port (one scan)."""
    sides = F.array(
        F.struct(F.lit(True).alias("is_dep"), F.col("departure_port").alias("port_name")),
        F.struct(F.lit(False).alias("is_dep"), F.col("arrival_port").alias("port_name")),
    )
    return (
        routes.select(*keep, "traffic_record_count", "total_passengers", "total_vehicles", F.explode(sides).alias("s"))
        .where(F.col("s.port_name").isNotNull())
        .select(*keep, F.col("s.port_name").alias("port_name"), F.col("s.is_dep").alias("is_dep"),
                "traffic_record_count", "total_passengers", "total_vehicles")
    )


def _side_sum(is_dep: bool, c: str) -> Column:
    cond = F.col("is_dep") if is_dep else ~F.col("is_dep")
    return F.coalesce(F.sum(F.when(cond, F.col(c)).otherwise(F.lit(0))), F.lit(0)).cast("long")


def ports_from_routes(routes: DataFrame) -> DataFrame:
    """ANA8: port-day facts rebuilt from route rows."""
    return _sides(routes, "service_date").groupBy("service_date", "port_name").agg(
        _side_sum(True, "traffic_record_count").alias("departure_record_count"),
        _side_sum(False, "traffic_record_count").alias("arrival_record_count"),
        _side_sum(True, "total_passengers").alias("total_departing_passengers"),
        _side_sum(False, "total_passengers").alias("total_arriving_passengers"),
        _side_sum(True, "total_vehicles").alias("total_departing_vehicles"),
        _side_sum(False, "total_vehicles").alias("total_arriving_vehicles"),
    )


def port_netflow(routes: DataFrame) -> DataFrame:
    """ANA9: per port departing/arriving sums and net flow, ranked by |net|.

    Same result as a full outer join of the departing and arriving sums with
    NULL→0, planned as ONE aggregation over both sides (one shuffle).
    """
    agg = _sides(routes).groupBy("port_name").agg(
        _side_sum(True, "total_passengers").alias("total_departing_passengers"),
        _side_sum(False, "total_passengers").alias("total_arriving_passengers"),
        _side_sum(True, "total_vehicles").alias("total_departing_vehicles"),
        _side_sum(False, "total_vehicles").alias("total_arriving_vehicles"),
    ).withColumn("net_flow", F.col("total_arriving_passengers") - F.col("total_departing_passengers"))
    # Port grain: bounded by the number of ports, fine in one task.
    w = Window.orderBy(F.abs("net_flow").desc(), F.col("net_flow").desc(), F.col("port_name").asc())
    return agg.withColumn("rank", F.row_number().over(w))


def netflow_reconcile(routes: DataFrame, ports: DataFrame) -> DataFrame:
    """ANA10: route-derived vs port-derived passenger totals per port (expected diffs 0)."""
    from_routes = _sides(routes).select(
        "port_name",
        F.when(F.col("is_dep"), F.col("total_passengers")).otherwise(0).alias("dep_routes"),
        F.when(~F.col("is_dep"), F.col("total_passengers")).otherwise(0).alias("arr_routes"),
        F.lit(0).cast("long").alias("dep_ports"),
        F.lit(0).cast("long").alias("arr_ports"),
    )
    from_ports = ports.where(F.col("port_name").isNotNull()).select(
        "port_name",
        F.lit(0).cast("long").alias("dep_routes"),
        F.lit(0).cast("long").alias("arr_routes"),
        F.col("total_departing_passengers").alias("dep_ports"),
        F.col("total_arriving_passengers").alias("arr_ports"),
    )
    m = from_routes.unionByName(from_ports).groupBy("port_name").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("dep_routes", "arr_routes", "dep_ports", "arr_ports")]
    )
    return (
        m.withColumn("net_routes", F.col("arr_routes") - F.col("dep_routes"))
        .withColumn("net_ports", F.col("arr_ports") - F.col("dep_ports"))
        .withColumn("dep_diff", F.col("dep_routes") - F.col("dep_ports"))
        .withColumn("arr_diff", F.col("arr_routes") - F.col("arr_ports"))
        .withColumn("net_diff", F.col("net_routes") - F.col("net_ports"))
        .withColumn("abs_net_diff", F.abs("net_diff"))
        .orderBy(F.col("abs_net_diff").desc(), "port_name")
    )


# --- ANA11–ANA15: KPI windows, baselines, deltas, congestion -------------------------

METRICS = ["pax", "veh", "sail", "active_corridors", "top_corridor_share", "top_port_flow"]


def _window_plan(daily_v: DataFrame, view: View) -> dict[str, Column]:
    """Scalar bounds of the current window and the baseline windows."""
    cur_end = view.last_day if view.last_day is not None else daily_v.agg(F.max("service_date")).scalar()
    cur_start = F.date_sub(cur_end, WINDOW_DAYS - 1)
    anchor = F.date_sub(cur_start, 1)
    has_room = anchor >= view.start
    full = F.date_sub(anchor, BASELINE_WINDOWS * WINDOW_DAYS - 1) >= view.start
    n = F.when(~has_room | cur_end.isNull(), 0).when(full, BASELINE_WINDOWS).otherwise(1)
    oldest = F.when(full, F.date_sub(anchor, BASELINE_WINDOWS * WINDOW_DAYS - 1)).otherwise(F.least(view.start, cur_start))
    return {"cur_end": cur_end, "cur_start": cur_start, "anchor": anchor, "full": full, "n": n, "oldest": oldest}


def _window_index(d: Column, p: dict[str, Column], view: View) -> Column:
    """0 = current window, 1..8 = baseline windows (1 is the newest), NULL = outside."""
    back = F.datediff(p["anchor"], d)
    return (
        F.when(d.between(p["cur_start"], p["cur_end"]), F.lit(0))
        .when((p["n"] == BASELINE_WINDOWS) & (back >= 0) & (back < BASELINE_WINDOWS * WINDOW_DAYS),
              F.floor(back / WINDOW_DAYS).cast("int") + 1)
        .when((p["n"] == 1) & d.between(view.start, p["anchor"]), F.lit(1))
    )


def window_metrics(daily: DataFrame, routes: DataFrame, ports: DataFrame, view: View) -> DataFrame:
    """ANA11/ANA12: metrics of the current window (0) and each baseline window (1..n).

    All windows in one pass per input: every day row is tagged with its
    window index and aggregated by it — no per-window re-scan, no range join.
    Corridors and ports are read from the oldest window's first day on (by
    month, where the frame is stored by month).
    """
    daily_v = view.apply(daily)
    p = _window_plan(daily_v, view)
    routes_v, ports_v = (within_days(view.apply(df), p["oldest"], p["cur_end"]) for df in (routes, ports))
    idx = _window_index(F.col("service_date"), p, view)

    d = daily_v.withColumn("w", idx).where(F.col("w").isNotNull()).groupBy("w").agg(
        F.sum("total_passengers").alias("pax"),
        F.sum("total_vehicles").alias("veh"),
        F.sum("rows_count").alias("sail"),
        (F.sum("distinct_route_pairs").cast("double") / F.count(F.lit(1)).cast("double")).alias("active_corridors"),
    )
    c = (
        routes_v.where(F.col("departure_port").isNotNull() & F.col("arrival_port").isNotNull())
        .withColumn("w", idx).where(F.col("w").isNotNull())
        .groupBy("w", "departure_port", "arrival_port").agg(F.sum("total_passengers").alias("cp"))
        .groupBy("w").agg(F.max("cp").alias("top_corridor_pax"))
    )
    t = (
        ports_v.where(F.col("port_name").isNotNull())
        .withColumn("w", idx).where(F.col("w").isNotNull())
        .groupBy("w", "port_name").agg(F.sum(F.col("total_departing_passengers") + F.col("total_arriving_passengers")).alias("fp"))
        .groupBy("w").agg(F.max("fp").alias("top_port_flow"))
    )
    # The window list comes from the plan (≤ 9 rows), so empty windows stay, with zeros.
    wins = daily_v.agg(F.lit(1).alias("one")).select(F.explode(F.sequence(F.lit(0), p["n"])).alias("w"))
    s = F.col("w")
    wins = wins.select(
        "w",
        F.when(s == 0, p["cur_start"])
        .when(p["n"] == 1, view.start)
        .otherwise(F.date_sub(p["anchor"], (s - 1) * WINDOW_DAYS + WINDOW_DAYS - 1)).alias("window_start"),
        F.when(s == 0, p["cur_end"]).otherwise(F.date_sub(p["anchor"], (s - 1) * WINDOW_DAYS)).alias("window_end"),
    ).where(p["cur_end"].isNotNull())
    m = wins.join(d, "w", "left").join(c, "w", "left").join(t, "w", "left")
    pax = F.coalesce(F.col("pax"), F.lit(0)).cast("long")
    return m.select(
        F.col("w").alias("window_index"),
        "window_start",
        "window_end",
        pax.alias("pax"),
        F.coalesce(F.col("veh"), F.lit(0)).cast("long").alias("veh"),
        F.coalesce(F.col("sail"), F.lit(0)).cast("long").alias("sail"),
        F.coalesce(F.col("active_corridors"), F.lit(0.0)).alias("active_corridors"),
        safe_share(F.coalesce(F.col("top_corridor_pax"), F.lit(0)), pax).alias("top_corridor_share"),
        F.coalesce(F.col("top_port_flow"), F.lit(0)).cast("long").alias("top_port_flow"),
    )


def window_kpis(metrics: DataFrame) -> DataFrame:
    """ANA11: the current window's KPIs."""
    return metrics.where(F.col("window_index") == 0).drop("window_index")


def baseline_windows(metrics: DataFrame) -> DataFrame:
    """ANA12: the baseline windows (8 × 7 days, or one from the view start)."""
    return metrics.where(F.col("window_index") >= 1)


def baseline_avg(metrics: DataFrame) -> DataFrame:
    """ANA13: per metric, the mean over baseline windows of values > 0 (0 if none)."""
    b = baseline_windows(metrics)
    return b.agg(
        F.count(F.lit(1)).alias("baseline_windows"),
        *[F.coalesce(F.avg(F.when(F.col(m) > 0, F.col(m).cast("double"))), F.lit(0.0)).alias(m) for m in METRICS],
    )


def kpi_deltas(metrics: DataFrame) -> DataFrame:
    """ANA14: current vs baseline per KPI card: delta %, label and direction."""
    # One global aggregate over the (≤ 9-row) window table gives both sides.
    w = F.col("window_index")
    joined = metrics.agg(
        *[F.coalesce(F.max(F.when(w == 0, F.col(m).cast("double"))), F.lit(0.0)).alias(f"c_{m}") for m in METRICS],
        *[F.coalesce(F.avg(F.when((w >= 1) & (F.col(m) > 0), F.col(m).cast("double"))), F.lit(0.0)).alias(f"b_{m}")
          for m in METRICS],
    )
    # Card metric and the suffix of its delta label.
    cards = [("pax", "vs Avg"), ("veh", "vs Avg"), ("active_corridors", "vs Baseline"),
             ("top_corridor_share", "vs Avg"), ("top_port_flow", "vs Avg"), ("sail", "vs Avg")]
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(sfx).alias("suffix"), F.col(f"c_{m}").alias("current"),
                 F.col(f"b_{m}").alias("baseline"))
        for m, sfx in cards
    ])
    x = joined.select(F.inline(rows))
    delta = F.when(F.col("baseline") != 0, (F.col("current") - F.col("baseline")) / F.col("baseline") * 100.0)
    flat = delta.isNull() | (F.abs(delta) < 0.05)
    return x.select(
        "metric", "current", "baseline",
        F.coalesce(delta, F.lit(0.0)).alias("delta_pct"),
        F.when(flat, F.concat(F.lit("0.0% "), F.col("suffix")))
        .otherwise(F.concat(F.when(delta > 0, F.lit("+")).otherwise(F.lit("")), fixed(delta, 1), F.lit("% "), F.col("suffix")))
        .alias("delta_label"),
        F.when(flat, "flat").when(delta > 0, "up").otherwise("down").alias("direction"),
    )


def congestion_index(daily_v: DataFrame) -> DataFrame:
    """ANA15: mean rows of the last 7 day rows over the linear 95th percentile, ×100, capped at 100."""
    last = Window.orderBy(F.col("service_date").desc())  # day grain only
    ranked = daily_v.withColumn("rn", F.row_number().over(last))
    agg = ranked.agg(
        F.avg(F.when(F.col("rn") <= 7, F.col("rows_count").cast("double"))).alias("recent_mean_rows"),
        F.percentile(F.col("rows_count").cast("double"), 0.95).alias("reference_peak"),
    )
    return agg.select(
        F.coalesce(F.col("recent_mean_rows"), F.lit(0.0)).alias("recent_mean_rows"),
        F.coalesce(F.col("reference_peak"), F.lit(0.0)).alias("reference_peak"),
        F.least(safe_share(F.coalesce(F.col("recent_mean_rows"), F.lit(0.0)), F.coalesce(F.col("reference_peak"), F.lit(0.0))),
                F.lit(100.0)).alias("congestion_index"),
    )


# --- ANA16–ANA17: rankings ---------------------------------------------------------------

def route_rank(routes: DataFrame) -> DataFrame:
    """Corridor sums (both ends known), ranked passengers, vehicles desc, label asc."""
    agg = (
        routes.where(F.col("departure_port").isNotNull() & F.col("arrival_port").isNotNull())
        .groupBy("departure_port", "arrival_port")
        .agg(
            F.sum("traffic_record_count").alias("sailings"),
            F.sum("total_passengers").alias("passengers"),
            F.sum("total_vehicles").alias("vehicles"),
        )
        .withColumn("pair_label", pair_label(F.col("departure_port"), F.col("arrival_port")))
    )
    return agg


def _ranked(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    # Top-k: ordering + limit (TakeOrderedAndProject), then number the k rows.
    top = df.orderBy(*order).limit(n) if n is not None else df
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def corridor_order() -> list[Column]:
    return [F.col("passengers").desc(), F.col("vehicles").desc(), F.col("pair_label").asc()]


def top_corridors(routes: DataFrame, n: int = 10) -> DataFrame:
    """ANA16."""
    return _ranked(route_rank(routes), corridor_order(), n)


def port_rank(ports: DataFrame) -> DataFrame:
    return ports.groupBy("port_name").agg(
        F.sum("total_departing_passengers").alias("total_departing_passengers"),
        F.sum("total_arriving_passengers").alias("total_arriving_passengers"),
        F.sum("total_departing_vehicles").alias("total_departing_vehicles"),
        F.sum("total_arriving_vehicles").alias("total_arriving_vehicles"),
    )


def port_balance(ports: DataFrame, n: int = 10) -> DataFrame:
    """ANA17: ordered by departing then arriving passengers; total for the top n."""
    order = [F.col("total_departing_passengers").desc(), F.col("total_arriving_passengers").desc(),
             F.col("port_name").asc_nulls_first()]
    return _ranked(port_rank(ports), order, n).withColumn(
        "total", F.col("total_departing_passengers") + F.col("total_arriving_passengers")
    )


# --- ANA18–ANA21: concentration, weekday profiles -------------------------------------

# Per grain, the calendar unit and the rows of the trailing mean.
PERIOD = {"daily": ("day", 7), "weekly": ("week", 4), "monthly": ("month", 3)}


def concentrations(daily: DataFrame, routes: DataFrame, grains: list[str] | None = None, top_k: int = 3) -> DataFrame:
    """ANA18 at several grains at once: grain, period_start, passengers of all and of the scope's top-k corridors, share, trailing mean.

    One aggregation of the corridor rows by GROUPING SETS gives the scope's
    sum of each corridor, which names the leaders, and its sums per period of
    every grain; another of the day rows gives the periods' totals.
    """
    grains = list(PERIOD) if grains is None else grains
    # days have no unit to cut to; a period is told from its sisters by which of the columns is set
    cut = {g: F.col("service_date") if g == "daily" else F.trunc("service_date", PERIOD[g][0]) for g in grains}
    grain = F.coalesce(*[F.when(F.grouping(g) == 0, g) for g in grains]).alias("grain")
    start = F.coalesce(*[F.when(F.grouping(g) == 0, F.col(g)) for g in grains]).alias("period_start")

    rows = routes.select(pair_label(F.col("departure_port"), F.col("arrival_port")).alias("pair_label"), "total_passengers", *[c.alias(g) for g, c in cut.items()])
    label, whole = F.col("pair_label"), [F.col(g) for g in grains]
    sets = rows.groupingSets([[label], *[[g, label] for g in whole]], label, *whole).agg(grain, start, F.sum("total_passengers").alias("p"))
    leaders = sets.where(F.col("grain").isNull()).orderBy(F.col("p").desc(), F.col("pair_label").asc()).limit(top_k).select("pair_label")
    # ``leaders`` holds at most top_k rows: a bounded broadcast.
    top = sets.where(F.col("grain").isNotNull()).join(F.broadcast(leaders), "pair_label", "left_semi")
    top = top.groupBy("grain", "period_start").agg(F.sum("p").alias("top_passengers"))
    days = daily.select("total_passengers", *[c.alias(g) for g, c in cut.items()])
    base = days.groupingSets([[g] for g in whole], *whole).agg(grain, start, F.sum("total_passengers").alias("total_passengers"))
    m = base.select("grain", "period_start", "total_passengers").join(top, ["grain", "period_start"], "left").withColumn(
        "top_passengers", F.coalesce(F.col("top_passengers"), F.lit(0)).cast("long")
    )
    share = F.when(F.col("total_passengers") != 0,
                   F.col("top_passengers").cast("double") / F.col("total_passengers").cast("double") * 100.0).otherwise(0.0)
    m = m.withColumn("top_share_pct", share)
    # Period grain (bounded by the calendar span), trailing windows of rows, min 1.
    by_start = Window.partitionBy("grain").orderBy("period_start")
    smooth = F.coalesce(*[F.when(F.col("grain") == g, F.avg("top_share_pct").over(by_start.rowsBetween(1 - PERIOD[g][1], 0))) for g in grains])
    return m.withColumn("top_share_pct_smooth", smooth)


def concentration(daily: DataFrame, routes: DataFrame, grain: str = "daily", top_k: int = 3) -> DataFrame:
    """ANA18: share of the top-k corridors of the scope per period, with a trailing mean."""
    return concentrations(daily, routes, [grain], top_k).drop("grain")


def weekday_month_matrix(daily: DataFrame) -> DataFrame:
    """ANA19: mean daily passengers by (yyyy-MM, weekday)."""
    return daily.groupBy(
        F.date_format("service_date", "yyyy-MM").alias("year_month"),
        F.date_format("service_date", "EEE").alias("weekday"),
    ).agg(F.avg(F.col("total_passengers").cast("double")).alias("avg_passengers"))


def weekday_profile(spark: SparkSession, daily: DataFrame) -> DataFrame:
    """ANA20: mean, day count, total per weekday; all 7 weekdays, Mon..Sun."""
    per_day = daily.groupBy("service_date").agg(F.coalesce(F.sum("total_passengers"), F.lit(0)).alias("tp"))
    stats = per_day.groupBy(F.date_format("service_date", "EEE").alias("weekday")).agg(
        F.avg(F.col("tp").cast("double")).alias("avg_passengers"),
        F.countDistinct("service_date").alias("day_count"),
        F.sum("tp").alias("total_passengers"),
    )
    # 7-row weekday dimension (1970-01-05 was a Monday); bounded broadcast.
    dim = spark.range(7).select(
        (F.col("id") + 1).cast("int").alias("weekday_order"),
        F.date_format(F.date_add(F.lit("1970-01-05").cast("date"), F.col("id").cast("int")), "EEE").alias("weekday"),
    )
    return dim.join(F.broadcast(stats), "weekday", "left").select(
        "weekday_order",
        "weekday",
        F.coalesce(F.col("avg_passengers"), F.lit(0.0)).alias("avg_passengers"),
        F.coalesce(F.col("day_count"), F.lit(0)).cast("long").alias("day_count"),
        F.coalesce(F.col("total_passengers"), F.lit(0)).cast("long").alias("total_passengers"),
    ).orderBy("weekday_order")


def weekday_summary(daily: DataFrame) -> DataFrame:
    """ANA21: start, end, days, total, Sunday average."""
    per_day = daily.groupBy("service_date").agg(F.coalesce(F.sum("total_passengers"), F.lit(0)).alias("tp"))
    sunday = F.date_format("service_date", "EEE") == "Sun"
    return per_day.agg(
        F.min("service_date").alias("start_date"),
        F.max("service_date").alias("end_date"),
        F.countDistinct("service_date").alias("days"),
        F.coalesce(F.sum("tp"), F.lit(0)).cast("long").alias("total_passengers"),
        F.coalesce(F.avg(F.when(sunday, F.col("tp").cast("double"))), F.lit(0.0)).alias("sunday_avg"),
    )


# --- ANA22–ANA26: corridor detail, trend, verify, leaders ------------------------------

def _per_sailing(c: str) -> Column:
    return F.when(F.col("sailings") != 0, F.col(c).cast("double") / F.col("sailings").cast("double")).otherwise(0.0)


def _scope_total(routes: DataFrame) -> Column:
    known = routes.where(F.col("departure_port").isNotNull() & F.col("arrival_port").isNotNull())
    return known.agg(F.coalesce(F.sum("total_passengers"), F.lit(0))).scalar()


def corridor_detail(routes: DataFrame, n: int = 10) -> DataFrame:
    """ANA23: top n corridors with share of the scope and per-sailing ratios."""
    total = _scope_total(routes)
    return top_corridors(routes, n).select(
        "rank", "pair_label", "sailings", "passengers", "vehicles",
        safe_share(F.col("passengers"), total).alias("share_pct"),
        _per_sailing("passengers").alias("passengers_per_sailing"),
        _per_sailing("vehicles").alias("vehicles_per_sailing"),
    )


def corridor_efficiency(routes: DataFrame, n: int = 10) -> DataFrame:
    """ANA22: as ANA23, keeping corridors with both ratios > 0."""
    return corridor_detail(routes, n).where((F.col("passengers_per_sailing") > 0) & (F.col("vehicles_per_sailing") > 0))


SERIES = ["total_passengers", "total_vehicles", "sailings"]


def _pulse(df: DataFrame, date_col: str) -> DataFrame:
    return df.select(F.col(date_col).alias("period"), "total_passengers", "total_vehicles",
                     F.col("rows_count").alias("sailings"))


def trend_long(daily_v: DataFrame, coarse_v: DataFrame | None = None, coarse_col: str | None = None) -> DataFrame:
    """ANA24: wide → (period, series, value); a coarse grain falls back to daily when empty."""
    if coarse_v is None:
        wide = _pulse(daily_v, "service_date")
    else:
        has = coarse_v.exists()
        wide = _pulse(coarse_v, coarse_col).unionByName(_pulse(daily_v, "service_date").where(~has))
    return wide.select(
        "period", *[F.col(c).cast("long").alias(c) for c in SERIES]
    ).unpivot("period", SERIES, "series", "value")


def timeseries_verify(df: DataFrame, date_col: str, pax: str, veh: str, rows: str) -> DataFrame:
    """ANA25: start, end, distinct points and the three sums (bad dates dropped, missing → 0)."""
    d = F.col(date_col).cast("string").try_cast("date")
    s = df.select(d.alias("d"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n)
                                  for c, n in ((pax, "passengers"), (veh, "vehicles"), (rows, "sailings"))])
    s = s.where(F.col("d").isNotNull())
    return s.agg(
        F.min("d").alias("start_date"), F.max("d").alias("end_date"), F.countDistinct("d").alias("points"),
        F.coalesce(F.sum("passengers"), F.lit(0.0)).alias("passengers"),
        F.coalesce(F.sum("vehicles"), F.lit(0.0)).alias("vehicles"),
        F.coalesce(F.sum("sailings"), F.lit(0.0)).alias("sailings"),
    )


def network_leaders(routes: DataFrame, n: int = 10) -> DataFrame:
    """ANA26: dominant corridor; port with the largest |net| among the top-n net-flow ports."""
    # Each leader is a ≤ 1-row top-1; a global aggregate turns it into exactly one row
    # (NULL when empty) and the net leader rides along as scalar subqueries.
    top = top_corridors(routes, 1)
    net = port_netflow(routes).where(F.col("rank") == 1)
    base = top.agg(
        F.first("pair_label").alias("top_corridor"), F.first("passengers").alias("top_corridor_passengers")
    ).select(
        "top_corridor", "top_corridor_passengers",
        net.agg(F.first("port_name")).scalar().alias("net_leader"),
        net.agg(F.first("net_flow")).scalar().alias("net_value"),
    )
    nv = F.coalesce(F.col("net_value"), F.lit(0))
    return base.select(
        F.coalesce(F.col("top_corridor"), F.lit("No data")).alias("top_corridor"),
        F.coalesce(F.col("top_corridor_passengers"), F.lit(0)).cast("long").alias("top_corridor_passengers"),
        F.coalesce(F.col("net_leader"), F.lit("No data")).alias("net_leader"),
        nv.cast("long").alias("net_value"),
        F.when(nv >= 0, "arrival-heavy").otherwise("departure-heavy").alias("net_direction"),
        F.concat(F.when(nv >= 0, F.lit("+")).otherwise(F.lit("-")), compact(F.abs(nv))).alias("net_value_compact"),
    )
