"""The panel's numbers for any number of nested views in one pass over each frame.

A view is a span of days that ends where the others end: the whole frame, or
its last n days (a *lookback*). Days are ordered from the newest: every sum or
mean of a view is then a running one, read off at the view's oldest day, so
each day row is aggregated once however many views there are (ordered frames,
``rowsBetween`` from the newest row). Corridor and port rows are aggregated
once by the set of views that hold them, the few sums are added up for each
view after that.

Two kinds of window meet here: "last 7 / prior 7 / last 30 / prior 30" count
day ROWS, the KPI window and the previous leader count CALENDAR days back from
the newest day of the views.

The only scalar subquery is the bounds of the days. It cuts the corridor and
port scans to the days that any view needs, on the month column as well if
the frame has one (``MONTH_COLUMN``), so stored months are pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portflow.functions.days import MONTH_COLUMN, within_days
from portflow.operators.panel_inputs import dated, prepare_daily, prepare_ports, prepare_routes

LEADERS = 5  # corridors and ports listed


def resolve_lookback(token: str, span_days: Column) -> Column:
    """Days of a lookback: ``full``, ``year`` or a number (at least 7)."""
    t = token.strip().lower()
    if t in {"full", "all"}:
        return F.greatest(span_days, F.lit(7))
    if t in {"year", "1y", "365", "last365", "last365d"}:
        return F.lit(365)
    return F.lit(max(7, int(t)))


class PanelViews:
    """Nested views over the three day-grain frames.

    ``lookbacks`` None is one view, the frames as they are; else the views
    end at the newest day, or at ``end_date`` if that is earlier, and are
    clipped to the days there are. ``ord`` numbers the views from 1.
    """

    def __init__(self, daily: DataFrame, lookbacks: list[str] | None = None, end_date: str | None = None, kpi_window_days: int = 7):
        self.n = max(7, int(kpi_window_days))
        self.lookbacks = lookbacks
        days = prepare_daily(daily)
        d = F.col("service_date")
        last = F.max(d) if end_date is None else F.least(F.lit(end_date).cast("date"), F.max(d))
        newest = F.max(d) if end_date is None else F.max(F.when(d <= F.lit(end_date).cast("date"), d))
        ends = days.agg(F.min(d).alias("first"), last.alias("last"), newest.alias("newest"))
        span = F.datediff("last", "first") + 1
        starts = [F.lit(None).cast("date")] if lookbacks is None else [
            F.date_sub("last", F.least(resolve_lookback(t, span), span) - 1) for t in lookbacks]
        ends = ends.select(
            "last", "newest", F.greatest(F.date_sub("newest", self.n - 1), "first").alias("kpi_start"),
            F.array(*[F.struct(F.lit(i + 1).alias("ord"), x.alias("start")) for i, x in enumerate(starts)]).alias("views"),
        )
        low = F.array_min(F.transform("views", lambda v: v["start"]))
        self.bounds = ends.select(F.struct("*", low.alias("low"), F.least("kpi_start", F.date_sub("newest", 13)).alias("recent_low"))).scalar()
        self.days = days if end_date is None else days.where(d <= F.lit(end_date).cast("date"))

    def table(self) -> DataFrame:
        """One row a view: ord, lookback."""
        tokens = F.array(*[F.lit(t) for t in self.lookbacks or ["frames"]])
        spark = self.days.sparkSession
        return spark.range(1, len(self.lookbacks or [1]) + 1, 1, 1).select(
            F.col("id").cast("int").alias("ord"), F.element_at(tokens, F.col("id").cast("int")).alias("lookback"))

    def day_part(self) -> DataFrame:
        """Per view with days: counts, KPI sums, row-window means and the peak, from one ordered pass."""
        d, n = F.col("service_date"), self.n
        newest_first = Window.orderBy(d.desc())  # the calendar bounds the day grain
        so_far = newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = self.days.select("*", F.row_number().over(newest_first).alias("rn"), F.lead(d).over(newest_first).alias("older"), self.bounds.alias("_b"))
        rn, p = F.col("rn"), F.col("total_passengers").cast("double")
        kpi = d >= F.col("_b.kpi_start")

        def mean(first: int, last: int, c: Column = p) -> Column:
            return F.avg(F.when(rn.between(first, last), c)).over(so_far)

        sums = {"passengers": "total_passengers", "vehicles": "total_vehicles", "traffic_rows": "rows_count"}
        rows = rows.select(
            "older", "_b", d.alias("view_start"), F.max(d).over(so_far).alias("newest"), rn.alias("n_rows"),
            *[F.coalesce(F.sum(F.when(kpi, F.col(c))).over(so_far), F.lit(0)).cast("long").alias(a) for a, c in sums.items()],
            F.sum("rows_count").over(so_far).alias("rows_sum"), F.sum("total_passengers").over(so_far).alias("pax_sum"),
            mean(1, 7, F.col("rows_count").cast("double")).alias("recent_rows_avg"),
            F.percentile(F.col("rows_count").cast("double"), 0.95).over(so_far).alias("reference_peak"),
            mean(1, 7).alias("r7"), mean(8, 14).alias("p7"), mean(1, 30).alias("r30"), mean(31, 60).alias("p30"),
            mean(1, n).alias("rn_"), mean(n + 1, 2 * n).alias("pn_"),
        )
        # a view is read off at its oldest day
        older, start = F.col("older"), F.col("view_start")
        ends = F.filter("_b.views", lambda v: (v["start"].isNull() & older.isNull()) | ((start >= v["start"]) & (older.isNull() | (older < v["start"]))))
        return rows.select(F.explode(ends).alias("v"), "*").select("v.ord", *[c for c in rows.columns if c not in ("older", "_b")])

    def _in_views(self, df: DataFrame, everything: bool) -> DataFrame:
        """Rows of any view with ``views``, the ords that hold them; of the KPI and previous windows only, if not ``everything``."""
        low, last = self.bounds.getField("low" if everything else "recent_low"), self.bounds.getField("last")
        if self.lookbacks is None:
            low, last = None if everything else low, None
        tagged = within_days(df, low, last).select("*", self.bounds.alias("_b"))
        d = F.col("service_date")
        return tagged.withColumn("views", F.transform(F.filter("_b.views", lambda v: v["start"].isNull() | (d >= v["start"])), lambda v: v["ord"]))

    def _corridors(self, routes: DataFrame, everything: bool) -> DataFrame:
        """ord, corridor, sums of the KPI window, the previous window, all days; known: both ports are named."""
        known = F.col("departure_port").isNotNull() & F.col("arrival_port").isNotNull()
        raw = dated(routes).withColumn("_known", known).withColumn("_raw", F.col("total_passengers"))
        keep = ["_known", "_raw"] + ([MONTH_COLUMN] if MONTH_COLUMN in routes.columns else [])
        rows = self._in_views(prepare_routes(raw, keep), everything)
        d = F.col("service_date")
        kpi = d.between(F.col("_b.kpi_start"), F.col("_b.newest"))
        prev = d.between(F.date_sub("_b.newest", 13), F.date_sub("_b.newest", 7))
        p, v = F.col("total_passengers"), F.col("total_vehicles")
        sums = {
            "kpi_rows": F.count(F.when(kpi, 1)), "kpi_pax": F.sum(F.when(kpi, p)), "kpi_veh": F.sum(F.when(kpi, v)),
            "prev_rows": F.count(F.when(prev, 1)), "prev_pax": F.sum(F.when(prev, p)), "pax": F.sum(p),
            "known_rows": F.count(F.when(F.col("_known"), 1)), "known_pax": F.sum(F.when(F.col("_known"), F.col("_raw"))),
        }
        once = rows.groupBy("views", "departure_port", "arrival_port").agg(*[c.alias(a) for a, c in sums.items()])
        return once.select(F.explode("views").alias("ord"), "*").groupBy("ord", "departure_port", "arrival_port").agg(*[F.sum(a).alias(a) for a in sums])

    def corridor_lists(self, routes: DataFrame, everything: bool = True) -> DataFrame:
        """Per view: the KPI window's leaders, the previous leader and (of all days) the digest of the version."""
        kinds = {"kpi": ("kpi_rows", "kpi_pax", F.col("kpi_veh")), "prev": ("prev_rows", "prev_pax", F.lit(0).cast("long"))}
        if everything:
            kinds["all"] = (None, "pax", F.lit(0).cast("long"))
        arr = F.array(*[
            F.struct(F.lit(k).alias("kind"), (F.lit(True) if c is None else F.col(c) > 0).alias("there"), F.col(p).alias("pax"), v.alias("veh"))
            for k, (c, p, v) in kinds.items()
        ])
        rows = self._corridors(routes, everything).select("ord", "departure_port", "arrival_port", F.explode(arr).alias("k"))
        rows = rows.where("k.there").select("ord", "departure_port", "arrival_port", "k.kind", "k.pax", "k.veh")
        order = Window.partitionBy("ord", "kind").orderBy(F.col("pax").desc(), F.col("veh").desc(), "departure_port", "arrival_port")
        top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LEADERS)
        pair = F.concat(F.col("departure_port"), F.lit(" -> "), F.col("arrival_port"))
        entry = F.struct("rank", pair.alias("pair_label"), F.col("pax").cast("long").alias("passengers"), F.col("veh").cast("long").alias("vehicles"))
        line = F.struct("rank", F.concat("departure_port", F.lit("->"), "arrival_port", F.lit(":"), F.col("pax").cast("long").cast("string")).alias("s"))
        listed = lambda kind, c: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, c)))
        digest = F.array_join(F.transform(listed("all", line), lambda x: x["s"]), "|")
        return top.groupBy("ord").agg(
            listed("kpi", entry).alias("leaders"),
            F.max(F.when((F.col("kind") == "prev") & (F.col("rank") == 1), pair)).alias("previous_top_corridor_label"),
            F.when(F.count(F.when(F.col("kind") == "all", 1)) > 0, digest).otherwise(F.lit("none")).alias("digest"),
        )

    def corridor_counts(self, routes: DataFrame, everything: bool = True) -> DataFrame:
        """Per view: corridors of the KPI window; the largest known corridor and the sum of all known ones."""
        known = F.when(F.col("known_rows") > 0, F.coalesce("known_pax", F.lit(0)))
        return self._corridors(routes, everything).groupBy("ord").agg(
            F.count(F.when(F.col("kpi_rows") > 0, 1)).alias("active_corridors"), F.max(known).alias("c_top"), F.sum(known).alias("c_total"))

    def port_list(self, ports: DataFrame) -> DataFrame:
        """Per view: the KPI window's leading ports."""
        keep = [MONTH_COLUMN] if MONTH_COLUMN in ports.columns else []
        rows = self._in_views(prepare_ports(ports, keep), False).where(F.col("service_date").between(F.col("_b.kpi_start"), F.col("_b.newest")))
        once = rows.groupBy("views", "port_name").agg(F.sum("total_passengers").alias("p"))
        each = once.select(F.explode("views").alias("ord"), "port_name", "p").groupBy("ord", "port_name").agg(F.sum("p").cast("long").alias("passengers"))
        order = Window.partitionBy("ord").orderBy(F.col("passengers").desc(), "port_name")
        top = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LEADERS)
        return top.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("rank", "port_name", "passengers"))).alias("top_ports"))
