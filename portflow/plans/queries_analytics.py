"""Registered dashboard analytics (ANA1–ANA26) and the compact number format.

Registered queries use the whole data range as the view (the ``full``
preset), except where the 90-day default view is itself the feature
(coverage of the default view, preset resolution).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from portflow.functions.fmt import compact
from portflow.operators import analytics as N
from portflow.plans.models import TrafficModels
from portflow.plans.oracle_base import cte, with_ctes
from portflow.plans.registry import register


def _m(spark, sf_dir):
    return TrafficModels(spark, sf_dir)


def _frames(spark, sf_dir, store: bool = False):
    # The full view needs no filter; all builders of a session read the route-day
    # grain that the first one stored. ``store`` adds its month column.
    m = _m(spark, sf_dir).materialize()
    view = N.full_view(m.daily)
    routes = m.routes_by_month if store else m.routes
    return m, view, view.apply(m.daily), view.apply(routes), view.apply(m.ports)


# ---- oracle building blocks ---------------------------------------------------------------
cte("vb", ("daily",), "SELECT MIN(service_date) AS vs, MAX(service_date) AS ve FROM daily")
cte("dv", ("daily", "vb"), "SELECT * FROM daily WHERE service_date BETWEEN (SELECT vs FROM vb) AND (SELECT ve FROM vb)")
cte("rv", ("routes", "vb"), "SELECT * FROM routes WHERE service_date BETWEEN (SELECT vs FROM vb) AND (SELECT ve FROM vb)")
cte("pv", ("ports", "vb"), "SELECT * FROM ports WHERE service_date BETWEEN (SELECT vs FROM vb) AND (SELECT ve FROM vb)")
cte(
    "wp",
    ("vb", "dv"),
    """
    SELECT vs, ve, cur_end, cur_end - 6 AS cur_start, cur_end - 7 AS anchor,
           CASE WHEN cur_end IS NULL OR cur_end - 7 < vs THEN 0 WHEN cur_end - 7 - 55 >= vs THEN 8 ELSE 1 END AS n
    FROM (SELECT vs, ve, (SELECT MAX(service_date) FROM dv) AS cur_end FROM vb)
    """,
)
_WIDX = """CASE WHEN {d} BETWEEN wp.cur_start AND wp.cur_end THEN 0
     WHEN wp.n = 8 AND date_diff('day', {d}, wp.anchor) BETWEEN 0 AND 55 THEN date_diff('day', {d}, wp.anchor) // 7 + 1
     WHEN wp.n = 1 AND {d} BETWEEN wp.vs AND wp.anchor THEN 1 END"""
cte(
    "wmet",
    ("wp", "dv", "rv", "pv"),
    f"""
    SELECT wn.w AS window_index, wn.window_start, wn.window_end,
           CAST(COALESCE(d.pax, 0) AS BIGINT) AS pax, CAST(COALESCE(d.veh, 0) AS BIGINT) AS veh,
           CAST(COALESCE(d.sail, 0) AS BIGINT) AS sail, COALESCE(d.active_corridors, 0.0) AS active_corridors,
           CASE WHEN COALESCE(d.pax, 0) != 0 THEN CAST(COALESCE(c.tcp, 0) AS DOUBLE) / CAST(d.pax AS DOUBLE) * 100.0 ELSE 0.0 END
             AS top_corridor_share,
           CAST(COALESCE(t.tpf, 0) AS BIGINT) AS top_port_flow
    FROM (
        SELECT w, CASE WHEN w = 0 THEN cur_start WHEN n = 1 THEN vs ELSE anchor - CAST((w - 1) * 7 + 6 AS INTEGER) END AS window_start,
               CASE WHEN w = 0 THEN cur_end ELSE anchor - CAST((w - 1) * 7 AS INTEGER) END AS window_end
        FROM (SELECT unnest(generate_series(0, n)) AS w, * FROM wp WHERE cur_end IS NOT NULL)
    ) wn
    LEFT JOIN (
        SELECT w, SUM(total_passengers) AS pax, SUM(total_vehicles) AS veh, SUM(rows_count) AS sail,
               CAST(SUM(distinct_route_pairs) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS active_corridors
        FROM (SELECT dv.*, {_WIDX.format(d='dv.service_date')} AS w FROM dv, wp) WHERE w IS NOT NULL GROUP BY w
    ) d ON d.w = wn.w
    LEFT JOIN (
        SELECT w, MAX(cp) AS tcp FROM (
            SELECT w, departure_port, arrival_port, SUM(total_passengers) AS cp
            FROM (SELECT rv.*, {_WIDX.format(d='rv.service_date')} AS w FROM rv, wp
                  WHERE departure_port IS NOT NULL AND arrival_port IS NOT NULL)
            WHERE w IS NOT NULL GROUP BY ALL) GROUP BY w
    ) c ON c.w = wn.w
    LEFT JOIN (
        SELECT w, MAX(fp) AS tpf FROM (
            SELECT w, port_name, SUM(total_departing_passengers + total_arriving_passengers) AS fp
            FROM (SELECT pv.*, {_WIDX.format(d='pv.service_date')} AS w FROM pv, wp WHERE port_name IS NOT NULL)
            WHERE w IS NOT NULL GROUP BY ALL) GROUP BY w
    ) t ON t.w = wn.w
    """,
)
_LABEL = "COALESCE(departure_port, 'Unknown') || ' -> ' || COALESCE(arrival_port, 'Unknown')"
cte(
    "rrank",
    ("rv",),
    f"""
    SELECT departure_port, arrival_port, CAST(SUM(traffic_record_count) AS BIGINT) AS sailings,
           CAST(SUM(total_passengers) AS BIGINT) AS passengers, CAST(SUM(total_vehicles) AS BIGINT) AS vehicles,
           {_LABEL} AS pair_label
    FROM rv WHERE departure_port IS NOT NULL AND arrival_port IS NOT NULL GROUP BY departure_port, arrival_port
    """,
)
cte(
    "netflow",
    ("rv",),
    """
    SELECT port_name, total_departing_passengers, total_arriving_passengers, total_departing_vehicles,
           total_arriving_vehicles, net_flow,
           row_number() OVER (ORDER BY abs(net_flow) DESC, net_flow DESC, port_name ASC) AS rank
    FROM (
      SELECT COALESCE(d.port_name, a.port_name) AS port_name,
             CAST(COALESCE(d.p, 0) AS BIGINT) AS total_departing_passengers,
             CAST(COALESCE(a.p, 0) AS BIGINT) AS total_arriving_passengers,
             CAST(COALESCE(d.v, 0) AS BIGINT) AS total_departing_vehicles,
             CAST(COALESCE(a.v, 0) AS BIGINT) AS total_arriving_vehicles,
             CAST(COALESCE(a.p, 0) - COALESCE(d.p, 0) AS BIGINT) AS net_flow
      FROM (SELECT departure_port AS port_name, SUM(total_passengers) AS p, SUM(total_vehicles) AS v FROM rv
            WHERE departure_port IS NOT NULL GROUP BY 1) d
      FULL OUTER JOIN (SELECT arrival_port AS port_name, SUM(total_passengers) AS p, SUM(total_vehicles) AS v FROM rv
            WHERE arrival_port IS NOT NULL GROUP BY 1) a ON d.port_name = a.port_name)
    """,
)


def _cov_sql() -> str:
    def part(scope: str, start: str, end: str, n: str) -> str:
        exp = f"greatest(date_diff('day', {start}, {end}) + 1, 0)"
        av = f"least(greatest({n}, 0), {exp})"
        return (
            f"SELECT '{scope}' AS scope, {start} AS start_date, {end} AS end_date, CAST({exp} AS BIGINT) AS expected_days, "
            f"CAST({av} AS BIGINT) AS available_days, CAST(greatest({exp} - {av}, 0) AS BIGINT) AS missing_days, "
            f"CASE WHEN {exp} <= 0 THEN 'No days in range' WHEN {exp} - {av} = 0 THEN printf('%d/%d days present', {av}, {exp}) "
            f"ELSE printf('%d/%d days present (%d missing)', {av}, {exp}, {exp} - {av}) END AS coverage_text"
        )

    return with_ctes(
        "SELECT * FROM (" + part("dataset", "b.mn", "b.mx", "(SELECT COUNT(DISTINCT service_date) FROM daily)") + " FROM b) "
        "UNION ALL SELECT * FROM (" + part("view", "v.vs", "v.ve",
                                        "(SELECT COUNT(DISTINCT service_date) FROM daily, v v2 WHERE service_date BETWEEN v2.vs AND v2.ve)")
        + " FROM v)",
        "daily", "b90",
    )


cte("b", ("daily",), "SELECT MIN(service_date) AS mn, MAX(service_date) AS mx FROM daily")
cte("b90", ("b",), "SELECT 1")
CTES_V = "SELECT greatest(mx - 89, mn) AS vs, mx AS ve FROM b"
cte("v", ("b",), CTES_V)
cte("b90", ("b", "v"), "SELECT 1")


@register("date_bounds", with_ctes(
    "SELECT MIN(service_date) AS min_date, MAX(service_date) AS max_date, COUNT(DISTINCT service_date) AS days_available FROM daily",
    "daily"))
def q_date_bounds(spark, sf_dir):
    return N.date_bounds(_m(spark, sf_dir).daily)


@register("coverage", _cov_sql())
def q_coverage(spark, sf_dir):
    d = _m(spark, sf_dir).daily
    return N.coverage(d, N.default_view(d))


@register("corridor_options", with_ctes(
    "SELECT DISTINCT departure_port, arrival_port, departure_port || ' -> ' || arrival_port AS corridor FROM routes "
    "WHERE departure_port IS NOT NULL AND arrival_port IS NOT NULL", "routes"))
def q_corridor_options(spark, sf_dir):
    return N.corridor_options(_m(spark, sf_dir).routes)


@register("port_options", with_ctes("SELECT DISTINCT port_name FROM ports WHERE port_name IS NOT NULL", "ports"))
def q_port_options(spark, sf_dir):
    return N.port_options(_m(spark, sf_dir).ports)


@register("preset_scope", with_ctes(
    """SELECT preset, least(s2, e2) AS start_date, greatest(s2, e2) AS end_date, s2 > e2 AS swapped FROM (
         SELECT preset, greatest(mn, least(s, mx)) AS s2, greatest(mn, least(e, mx)) AS e2 FROM (
           SELECT mn, mx, 'Last 30D' AS preset, mx - 29 AS s, mx AS e FROM b
           UNION ALL SELECT mn, mx, 'Last 90D', mx - 89, mx FROM b
           UNION ALL SELECT mn, mx, 'YTD', CAST(date_trunc('year', mx) AS DATE), mx FROM b
           UNION ALL SELECT mn, mx, 'Custom', mx + 10, mn + 30 FROM b))""", "b"))
def q_preset_scope(spark, sf_dir):
    """Custom range chosen past both ends (exercises clamp and swap)."""
    return N.preset_scope(_m(spark, sf_dir).daily, F.date_add(F.col("mx"), 10), F.date_add(F.col("mn"), 30))


@register("refresh_token", with_ctes(
    "SELECT COALESCE(CAST(MAX(service_date) AS VARCHAR) || '|' || CAST(COUNT(*) AS VARCHAR) || '|' || "
    "CAST(COALESCE(SUM(rows_count), 0) AS VARCHAR), 'unavailable') AS data_token FROM daily", "daily"))
def q_refresh_token(spark, sf_dir):
    return N.refresh_token(_m(spark, sf_dir).daily)


@register("scope_routes", with_ctes(
    """SELECT * FROM routes WHERE departure_port = (SELECT port_name FROM (
           SELECT port_name, SUM(total_departing_passengers + total_arriving_passengers) AS p FROM ports
           WHERE port_name IS NOT NULL GROUP BY port_name ORDER BY p DESC, port_name LIMIT 1))
       OR arrival_port = (SELECT port_name FROM (
           SELECT port_name, SUM(total_departing_passengers + total_arriving_passengers) AS p FROM ports
           WHERE port_name IS NOT NULL GROUP BY port_name ORDER BY p DESC, port_name LIMIT 1))""", "routes", "ports"))
def q_scope_routes(spark, sf_dir):
    """Routes touching the busiest port (the port is a scalar subquery over the stored port days)."""
    m = _m(spark, sf_dir).materialize()
    flow = m.ports.where(F.col("port_name").isNotNull()).groupBy("port_name").agg(
        F.sum(F.col("total_departing_passengers") + F.col("total_arriving_passengers")).alias("p"))
    port = flow.orderBy(F.col("p").desc(), "port_name").limit(1).select("port_name").scalar()
    return N.scope_routes(m.routes, port=port)


def _leader(spark, sf_dir):
    """The leading corridor, from the stored route-day grain: (models, departure, arrival) with scalar subqueries."""
    m = _m(spark, sf_dir).materialize()
    top = N.top_corridors(m.routes, 1).agg(F.struct(F.first("departure_port").alias("d"), F.first("arrival_port").alias("a"))).scalar()
    return m, top.getField("d"), top.getField("a")


_LEADER_SQL = "(SELECT departure_port, arrival_port FROM rrank ORDER BY passengers DESC, vehicles DESC, pair_label LIMIT 1)"
_IN_LEADER = f"(departure_port, arrival_port) IN {_LEADER_SQL}"


@register("scope_corridor", with_ctes(f"SELECT * FROM routes WHERE {_IN_LEADER}", "routes", "rrank"))
def q_scope_corridor(spark, sf_dir):
    """ANA6: rows of one corridor, the leading one."""
    m, dep, arr = _leader(spark, sf_dir)
    return N.scope_routes(m.routes, corridor=(dep, arr))


@register("scope_corridor_and_port", with_ctes(
    f"""SELECT CASE WHEN s = 1 THEN 'arrival' ELSE 'other' END AS port_choice, COUNT(service_date) AS rows_count,
               CAST(COALESCE(SUM(total_passengers), 0) AS BIGINT) AS total_passengers
        FROM (VALUES (1), (2)) c(s) LEFT JOIN (SELECT * FROM routes WHERE {_IN_LEADER}) r ON s = 1 GROUP BY s""", "routes", "rrank"))
def q_scope_corridor_and_port(spark, sf_dir):
    """ANA6: corridor, then a port; one at an end of the corridor changes nothing, one elsewhere leaves no row."""
    m, dep, arr = _leader(spark, sf_dir)
    other = m.routes.where((F.col("departure_port") != dep) & (F.col("departure_port") != arr)).agg(F.min("departure_port")).scalar()
    out = None
    for choice, port in (("arrival", arr), ("other", other)):
        rows = N.scope_routes(m.routes, corridor=(dep, arr), port=port).agg(
            F.count("service_date").alias("rows_count"), F.coalesce(F.sum("total_passengers"), F.lit(0)).alias("total_passengers"))
        rows = rows.select(F.lit(choice).alias("port_choice"), "rows_count", "total_passengers")
        out = rows if out is None else out.unionByName(rows)
    return out


@register("scoped_corridor_daily", with_ctes(
    f"""SELECT service_date, CAST(SUM(traffic_record_count) AS BIGINT) AS rows_count, COUNT(DISTINCT {_LABEL}) AS distinct_route_pairs,
               CAST(SUM(total_passengers) AS BIGINT) AS total_passengers, CAST(SUM(total_vehicles) AS BIGINT) AS total_vehicles
        FROM routes WHERE {_IN_LEADER} GROUP BY service_date""", "routes", "rrank"))
def q_scoped_corridor_daily(spark, sf_dir):
    """ANA6 then ANA7: the day frame that the dashboard rebuilds from a corridor's rows."""
    m, dep, arr = _leader(spark, sf_dir)
    return N.daily_from_routes(N.scope_routes(m.routes, corridor=(dep, arr)))


@register("daily_from_routes", with_ctes(
    f"SELECT service_date, CAST(SUM(traffic_record_count) AS BIGINT) AS rows_count, COUNT(DISTINCT {_LABEL}) AS distinct_route_pairs, "
    "CAST(SUM(total_passengers) AS BIGINT) AS total_passengers, CAST(SUM(total_vehicles) AS BIGINT) AS total_vehicles "
    "FROM rv GROUP BY service_date", "rv"))
def q_daily_from_routes(spark, sf_dir):
    return N.daily_from_routes(_frames(spark, sf_dir)[3])


_PFR_MEASURES = ("departure_record_count", "arrival_record_count", "total_departing_passengers",
                 "total_arriving_passengers", "total_departing_vehicles", "total_arriving_vehicles")


@register("ports_from_routes", with_ctes(
    "SELECT service_date, port_name, " + ", ".join(f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in _PFR_MEASURES) + " FROM ("
    "SELECT service_date, departure_port AS port_name, traffic_record_count AS departure_record_count, 0 AS arrival_record_count, "
    "total_passengers AS total_departing_passengers, 0 AS total_arriving_passengers, total_vehicles AS total_departing_vehicles, "
    "0 AS total_arriving_vehicles FROM rv WHERE departure_port IS NOT NULL UNION ALL "
    "SELECT service_date, arrival_port, 0, traffic_record_count, 0, total_passengers, 0, total_vehicles FROM rv "
    "WHERE arrival_port IS NOT NULL) GROUP BY service_date, port_name", "rv"))
def q_ports_from_routes(spark, sf_dir):
    return N.ports_from_routes(_frames(spark, sf_dir)[3])


@register("port_netflow", with_ctes("SELECT * FROM netflow", "netflow"))
def q_port_netflow(spark, sf_dir):
    return N.port_netflow(_frames(spark, sf_dir)[3])


@register("netflow_reconcile", with_ctes(
    """SELECT port_name, dep_routes, arr_routes, dep_ports, arr_ports, net_routes, net_ports,
              dep_routes - dep_ports AS dep_diff, arr_routes - arr_ports AS arr_diff, net_routes - net_ports AS net_diff,
              abs(net_routes - net_ports) AS abs_net_diff
       FROM (SELECT COALESCE(r.port_name, p.port_name) AS port_name,
                    CAST(COALESCE(r.dep, 0) AS BIGINT) AS dep_routes, CAST(COALESCE(r.arr, 0) AS BIGINT) AS arr_routes,
                    CAST(COALESCE(p.dep, 0) AS BIGINT) AS dep_ports, CAST(COALESCE(p.arr, 0) AS BIGINT) AS arr_ports,
                    CAST(COALESCE(r.arr, 0) - COALESCE(r.dep, 0) AS BIGINT) AS net_routes,
                    CAST(COALESCE(p.arr, 0) - COALESCE(p.dep, 0) AS BIGINT) AS net_ports
             FROM (SELECT port_name, total_departing_passengers AS dep, total_arriving_passengers AS arr FROM netflow) r
             FULL OUTER JOIN (SELECT port_name, SUM(total_departing_passengers) AS dep, SUM(total_arriving_passengers) AS arr
                              FROM pv WHERE port_name IS NOT NULL GROUP BY port_name) p ON r.port_name = p.port_name)""",
    "netflow", "pv"))
def q_netflow_reconcile(spark, sf_dir):
    _, _, _, r, p = _frames(spark, sf_dir)
    return N.netflow_reconcile(r, p)


def _metrics(spark, sf_dir):
    m, view, d, r, p = _frames(spark, sf_dir, store=True)
    return N.window_metrics(d, r, p, view)


@register("window_kpis", with_ctes("SELECT * EXCLUDE (window_index) FROM wmet WHERE window_index = 0", "wmet"))
def q_window_kpis(spark, sf_dir):
    return N.window_kpis(_metrics(spark, sf_dir))


@register("baseline_windows", with_ctes("SELECT * FROM wmet WHERE window_index >= 1", "wmet"))
def q_baseline_windows(spark, sf_dir):
    return N.baseline_windows(_metrics(spark, sf_dir))


_MET = ["pax", "veh", "sail", "active_corridors", "top_corridor_share", "top_port_flow"]


@register("baseline_avg", with_ctes(
    "SELECT COUNT(*) AS baseline_windows, " + ", ".join(
        f"COALESCE(AVG(CASE WHEN {m} > 0 THEN CAST({m} AS DOUBLE) END), 0.0) AS {m}" for m in _MET)
    + " FROM wmet WHERE window_index >= 1", "wmet"))
def q_baseline_avg(spark, sf_dir):
    return N.baseline_avg(_metrics(spark, sf_dir))


def _deltas_sql() -> str:
    cards = [("pax", "vs Avg"), ("veh", "vs Avg"), ("active_corridors", "vs Baseline"),
             ("top_corridor_share", "vs Avg"), ("top_port_flow", "vs Avg"), ("sail", "vs Avg")]
    agg = ", ".join(
        f"COALESCE(MAX(CASE WHEN window_index = 0 THEN CAST({m} AS DOUBLE) END), 0.0) AS c_{m}, "
        f"COALESCE(AVG(CASE WHEN window_index >= 1 AND {m} > 0 THEN CAST({m} AS DOUBLE) END), 0.0) AS b_{m}"
        for m in _MET
    )
    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, '{s}' AS suffix, c_{m} AS current, b_{m} AS baseline FROM a" for m, s in cards
    )
    delta = "CASE WHEN baseline != 0 THEN (current - baseline) / baseline * 100.0 END"
    return with_ctes(
        f"""WITH a AS (SELECT {agg} FROM wmet), x AS ({rows}), y AS (SELECT *, {delta} AS delta FROM x)
        SELECT metric, current, baseline, COALESCE(delta, 0.0) AS delta_pct,
               CASE WHEN delta IS NULL OR abs(delta) < 0.05 THEN '0.0% ' || suffix
                    ELSE (CASE WHEN delta > 0 THEN '+' ELSE '' END) || printf('%.1f', delta) || '% ' || suffix END AS delta_label,
               CASE WHEN delta IS NULL OR abs(delta) < 0.05 THEN 'flat' WHEN delta > 0 THEN 'up' ELSE 'down' END AS direction
        FROM y""".replace("WITH a AS", "SELECT * FROM (WITH a AS", 1) + ")",
        "wmet",
    )


@register("kpi_deltas", _deltas_sql())
def q_kpi_deltas(spark, sf_dir):
    return N.kpi_deltas(_metrics(spark, sf_dir))


@register("congestion_index", with_ctes(
    """SELECT recent_mean_rows, reference_peak,
              least(CASE WHEN reference_peak != 0 THEN recent_mean_rows / reference_peak * 100.0 ELSE 0.0 END, 100.0) AS congestion_index
       FROM (SELECT COALESCE(AVG(CASE WHEN rn <= 7 THEN CAST(rows_count AS DOUBLE) END), 0.0) AS recent_mean_rows,
                    COALESCE(quantile_cont(CAST(rows_count AS DOUBLE), 0.95), 0.0) AS reference_peak
             FROM (SELECT rows_count, row_number() OVER (ORDER BY service_date DESC) AS rn FROM dv))""", "dv"))
def q_congestion_index(spark, sf_dir):
    return N.congestion_index(_frames(spark, sf_dir)[2])


_TOPC = ("SELECT *, row_number() OVER (ORDER BY passengers DESC, vehicles DESC, pair_label) AS rank FROM ("
         "SELECT * FROM {src} ORDER BY passengers DESC, vehicles DESC, pair_label LIMIT {n})")


@register("top_corridors", with_ctes(_TOPC.format(src="rrank", n=10), "rrank"))
def q_top_corridors(spark, sf_dir):
    return N.top_corridors(_frames(spark, sf_dir)[3], 10)


cte("rv_kpi", ("rv", "wp"), "SELECT rv.* FROM rv, wp WHERE rv.service_date BETWEEN wp.cur_start AND wp.cur_end")
cte("pv_kpi", ("pv", "wp"), "SELECT pv.* FROM pv, wp WHERE pv.service_date BETWEEN wp.cur_start AND wp.cur_end")
cte(
    "rrank_kpi",
    ("rv_kpi",),
    f"""SELECT departure_port, arrival_port, CAST(SUM(traffic_record_count) AS BIGINT) AS sailings,
           CAST(SUM(total_passengers) AS BIGINT) AS passengers, CAST(SUM(total_vehicles) AS BIGINT) AS vehicles,
           {_LABEL} AS pair_label
    FROM rv_kpi WHERE departure_port IS NOT NULL AND arrival_port IS NOT NULL GROUP BY departure_port, arrival_port""",
)


def _kpi_frames(spark, sf_dir):
    m, view, d, r, p = _frames(spark, sf_dir, store=True)
    cur_end = view.last_day
    cur = N.View(F.date_sub(cur_end, 6), cur_end, cur_end)
    return cur.apply(r), cur.apply(p)


@register("top_corridors_kpi", with_ctes(_TOPC.format(src="rrank_kpi", n=10), "rrank_kpi"))
def q_top_corridors_kpi(spark, sf_dir):
    """ANA16 over the current 7-day KPI window."""
    return N.top_corridors(_kpi_frames(spark, sf_dir)[0], 10)


_PB = """SELECT *, total_departing_passengers + total_arriving_passengers AS total FROM (
    SELECT *, row_number() OVER (ORDER BY total_departing_passengers DESC, total_arriving_passengers DESC, port_name NULLS FIRST) AS rank
    FROM (SELECT port_name, CAST(SUM(total_departing_passengers) AS BIGINT) AS total_departing_passengers,
                 CAST(SUM(total_arriving_passengers) AS BIGINT) AS total_arriving_passengers,
                 CAST(SUM(total_departing_vehicles) AS BIGINT) AS total_departing_vehicles,
                 CAST(SUM(total_arriving_vehicles) AS BIGINT) AS total_arriving_vehicles
          FROM {src} GROUP BY port_name
          ORDER BY total_departing_passengers DESC, total_arriving_passengers DESC, port_name NULLS FIRST LIMIT 10))"""


@register("port_balance", with_ctes(_PB.format(src="pv"), "pv"))
def q_port_balance(spark, sf_dir):
    return N.port_balance(_frames(spark, sf_dir)[4], 10)


@register("port_balance_kpi", with_ctes(_PB.format(src="pv_kpi"), "pv_kpi"))
def q_port_balance_kpi(spark, sf_dir):
    """ANA17 over the current 7-day KPI window."""
    return N.port_balance(_kpi_frames(spark, sf_dir)[1], 10)


def _conc_sql(unit: str | None, smooth: int) -> str:
    per = "service_date" if unit is None else f"CAST(date_trunc('{unit}', service_date) AS DATE)"
    return with_ctes(
        f"""SELECT period_start, total_passengers, top_passengers, top_share_pct,
                   AVG(top_share_pct) OVER (ORDER BY period_start ROWS BETWEEN {smooth - 1} PRECEDING AND CURRENT ROW) AS top_share_pct_smooth
            FROM (SELECT b.period_start, b.total_passengers, CAST(COALESCE(t.tp, 0) AS BIGINT) AS top_passengers,
                         CASE WHEN b.total_passengers != 0 THEN CAST(COALESCE(t.tp, 0) AS DOUBLE) / CAST(b.total_passengers AS DOUBLE) * 100.0
                              ELSE 0.0 END AS top_share_pct
                  FROM (SELECT {per} AS period_start, CAST(SUM(total_passengers) AS BIGINT) AS total_passengers FROM dv GROUP BY 1) b
                  LEFT JOIN (SELECT {per} AS period_start, SUM(total_passengers) AS tp FROM rv
                             WHERE {_LABEL} IN (SELECT lbl FROM (SELECT {_LABEL} AS lbl, SUM(total_passengers) AS p FROM rv
                                                GROUP BY 1 ORDER BY p DESC, lbl LIMIT 3))
                             GROUP BY 1) t ON t.period_start = b.period_start)""",
        "dv", "rv",
    )


_CONC = [("daily", None, 7), ("weekly", "week", 4), ("monthly", "month", 3)]
for _g, _u, _sm in _CONC:

    def _conc(spark, sf_dir, _g=_g):
        _, _, d, r, _p = _frames(spark, sf_dir)
        return N.concentration(d, r, _g)

    register(f"concentration_{_g}", _conc_sql(_u, _sm))(_conc)


@register("concentration_grains", " UNION ALL ".join(
    f"SELECT '{g}' AS grain, * FROM ({_conc_sql(u, sm)})" for g, u, sm in _CONC))
def q_concentration_grains(spark, sf_dir):
    """ANA18 at all three grains from one aggregation by grouping sets."""
    _, _, d, r, _ = _frames(spark, sf_dir)
    return N.concentrations(d, r)


@register("weekday_month_matrix", with_ctes(
    "SELECT strftime(service_date, '%Y-%m') AS year_month, strftime(service_date, '%a') AS weekday, "
    "AVG(CAST(total_passengers AS DOUBLE)) AS avg_passengers FROM dv GROUP BY 1, 2", "dv"))
def q_weekday_month_matrix(spark, sf_dir):
    return N.weekday_month_matrix(_frames(spark, sf_dir)[2])


@register("weekday_profile", with_ctes(
    """SELECT w.weekday_order, w.weekday, COALESCE(s.avg_passengers, 0.0) AS avg_passengers,
              CAST(COALESCE(s.day_count, 0) AS BIGINT) AS day_count, CAST(COALESCE(s.total_passengers, 0) AS BIGINT) AS total_passengers
       FROM (VALUES (1, 'Mon'), (2, 'Tue'), (3, 'Wed'), (4, 'Thu'), (5, 'Fri'), (6, 'Sat'), (7, 'Sun')) AS w(weekday_order, weekday)
       LEFT JOIN (SELECT strftime(service_date, '%a') AS weekday, AVG(CAST(tp AS DOUBLE)) AS avg_passengers,
                         COUNT(DISTINCT service_date) AS day_count, SUM(tp) AS total_passengers
                  FROM (SELECT service_date, COALESCE(SUM(total_passengers), 0) AS tp FROM dv GROUP BY 1) GROUP BY 1) s
       ON s.weekday = w.weekday""", "dv"))
def q_weekday_profile(spark, sf_dir):
    return N.weekday_profile(spark, _frames(spark, sf_dir)[2])


@register("weekday_summary", with_ctes(
    """SELECT MIN(service_date) AS start_date, MAX(service_date) AS end_date, COUNT(DISTINCT service_date) AS days,
              CAST(COALESCE(SUM(tp), 0) AS BIGINT) AS total_passengers,
              COALESCE(AVG(CASE WHEN strftime(service_date, '%a') = 'Sun' THEN CAST(tp AS DOUBLE) END), 0.0) AS sunday_avg
       FROM (SELECT service_date, COALESCE(SUM(total_passengers), 0) AS tp FROM dv GROUP BY 1)""", "dv"))
def q_weekday_summary(spark, sf_dir):
    return N.weekday_summary(_frames(spark, sf_dir)[2])


_DETAIL = """SELECT rank, pair_label, sailings, passengers, vehicles,
       CASE WHEN tot != 0 THEN CAST(passengers AS DOUBLE) / CAST(tot AS DOUBLE) * 100.0 ELSE 0.0 END AS share_pct,
       CASE WHEN sailings != 0 THEN CAST(passengers AS DOUBLE) / CAST(sailings AS DOUBLE) ELSE 0.0 END AS passengers_per_sailing,
       CASE WHEN sailings != 0 THEN CAST(vehicles AS DOUBLE) / CAST(sailings AS DOUBLE) ELSE 0.0 END AS vehicles_per_sailing
FROM (""" + _TOPC.format(src="rrank", n=10) + """), (SELECT COALESCE(SUM(passengers), 0) AS tot FROM rrank)"""


@register("corridor_detail", with_ctes(_DETAIL, "rrank"))
def q_corridor_detail(spark, sf_dir):
    return N.corridor_detail(_frames(spark, sf_dir)[3], 10)


@register("corridor_efficiency", with_ctes(
    f"SELECT * FROM ({_DETAIL}) WHERE passengers_per_sailing > 0 AND vehicles_per_sailing > 0", "rrank"))
def q_corridor_efficiency(spark, sf_dir):
    return N.corridor_efficiency(_frames(spark, sf_dir)[3], 10)


def _trend_sql(src: str, col: str) -> str:
    return (f"SELECT period, series, value FROM (SELECT {col} AS period, CAST(total_passengers AS BIGINT) AS total_passengers, "
            f"CAST(total_vehicles AS BIGINT) AS total_vehicles, CAST(rows_count AS BIGINT) AS sailings FROM {src}) "
            "UNPIVOT (value FOR series IN (total_passengers, total_vehicles, sailings))")


@register("trend_long_daily", with_ctes(_trend_sql("dv", "service_date"), "dv"))
def q_trend_long_daily(spark, sf_dir):
    return N.trend_long(_frames(spark, sf_dir)[2])


cte("wv", ("row_counts_weekly", "vb"),
    "SELECT * FROM row_counts_weekly WHERE week_start BETWEEN (SELECT vs FROM vb) AND (SELECT ve FROM vb)")
cte("mv", ("row_counts_monthly", "vb"),
    "SELECT * FROM row_counts_monthly WHERE year_month BETWEEN (SELECT vs FROM vb) AND (SELECT ve FROM vb)")


def _trend_coarse_sql(src: str, col: str) -> str:
    return with_ctes(
        f"SELECT * FROM ({_trend_sql(src, col)}) UNION ALL "
        f"SELECT * FROM ({_trend_sql('dv', 'service_date')}) WHERE NOT EXISTS (SELECT 1 FROM {src})",
        src, "dv",
    )


@register("trend_long_weekly", _trend_coarse_sql("wv", "week_start"))
def q_trend_long_weekly(spark, sf_dir):
    m, view, d, _r, _p = _frames(spark, sf_dir)
    return N.trend_long(d, view.apply(m.row_counts_weekly, "week_start"), "week_start")


@register("trend_long_monthly", _trend_coarse_sql("mv", "year_month"))
def q_trend_long_monthly(spark, sf_dir):
    m, view, d, _r, _p = _frames(spark, sf_dir)
    return N.trend_long(d, view.apply(m.row_counts_monthly, "year_month"), "year_month")


@register("timeseries_verify", with_ctes(
    "SELECT MIN(service_date) AS start_date, MAX(service_date) AS end_date, COUNT(DISTINCT service_date) AS points, "
    "COALESCE(SUM(CAST(total_passengers AS DOUBLE)), 0.0) AS passengers, COALESCE(SUM(CAST(total_vehicles AS DOUBLE)), 0.0) AS vehicles, "
    "COALESCE(SUM(CAST(rows_count AS DOUBLE)), 0.0) AS sailings FROM dv WHERE service_date IS NOT NULL", "dv"))
def q_timeseries_verify(spark, sf_dir):
    return N.timeseries_verify(_frames(spark, sf_dir)[2], "service_date", "total_passengers", "total_vehicles", "rows_count")


def _compact_sql(x: str) -> str:
    """DuckDB form of the compact number format (printf rounds like Python)."""
    r = f"CAST(round_even(CAST({x} AS DOUBLE), 0) AS BIGINT)"
    grouped = (f"CASE WHEN abs({r}) >= 1000 THEN (CASE WHEN {r} < 0 THEN '-' ELSE '' END) || CAST(abs({r}) // 1000 AS VARCHAR) || ',' "
               f"|| lpad(CAST(abs({r}) % 1000 AS VARCHAR), 3, '0') ELSE CAST({r} AS VARCHAR) END")
    return (f"CASE WHEN abs({x}) >= 1000000 THEN printf('%.2fM', {x} / 1000000.0) "
            f"WHEN abs({x}) >= 100000 THEN printf('%.0fk', {x} / 1000.0) "
            f"WHEN abs({x}) >= 10000 THEN printf('%.1fk', {x} / 1000.0) ELSE {grouped} END")


@register("network_leaders", with_ctes(
    f"""SELECT COALESCE(tc.pair_label, 'No data') AS top_corridor, CAST(COALESCE(tc.passengers, 0) AS BIGINT) AS top_corridor_passengers,
              COALESCE(nl.port_name, 'No data') AS net_leader, CAST(COALESCE(nl.net_flow, 0) AS BIGINT) AS net_value,
              CASE WHEN COALESCE(nl.net_flow, 0) >= 0 THEN 'arrival-heavy' ELSE 'departure-heavy' END AS net_direction,
              (CASE WHEN COALESCE(nl.net_flow, 0) >= 0 THEN '+' ELSE '-' END) || {_compact_sql('abs(COALESCE(nl.net_flow, 0))')} AS net_value_compact
       FROM (SELECT 1 AS one) o
       LEFT JOIN (SELECT * FROM rrank ORDER BY passengers DESC, vehicles DESC, pair_label LIMIT 1) tc ON TRUE
       LEFT JOIN (SELECT * FROM netflow WHERE rank = 1) nl ON TRUE""", "rrank", "netflow"))
def q_network_leaders(spark, sf_dir):
    return N.network_leaders(_frames(spark, sf_dir)[3], 10)


@register("fmt_compact", with_ctes(
    f"""SELECT grain, period_start, total_passengers, {_compact_sql('total_passengers')} AS passengers_compact FROM (
          SELECT 'daily' AS grain, service_date AS period_start, total_passengers FROM row_counts_daily
          UNION ALL SELECT 'weekly', week_start, total_passengers FROM row_counts_weekly
          UNION ALL SELECT 'monthly', year_month, total_passengers FROM row_counts_monthly
          UNION ALL SELECT 'yearly', make_date(year, 1, 1), total_passengers FROM row_counts_yearly)""",
    "row_counts_daily", "row_counts_weekly", "row_counts_monthly", "row_counts_yearly"))
def q_fmt_compact(spark, sf_dir):
    """PAN-N over the passenger totals of every grain (reaches all four branches)."""
    m = _m(spark, sf_dir)
    parts = [
        m.row_counts_daily.select(F.lit("daily").alias("grain"), F.col("service_date").alias("period_start"), "total_passengers"),
        m.row_counts_weekly.select(F.lit("weekly"), F.col("week_start"), "total_passengers"),
        m.row_counts_monthly.select(F.lit("monthly"), F.col("year_month"), "total_passengers"),
        m.row_counts_yearly.select(F.lit("yearly"), F.make_date(F.col("year"), F.lit(1), F.lit(1)), "total_passengers"),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.union(p)
    return u.withColumn("passengers_compact", compact(F.col("total_passengers")))
