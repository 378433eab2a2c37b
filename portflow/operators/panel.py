"""Panel layer: notable-change rules, the panel source document, the rendered
report card, the live four-paragraph report and snapshot-table helpers.

Everything is derived from the day-grain frames (daily / routes / ports of
a view) in Spark: one aggregate over the day rows (ranked newest first for
the row-count windows), scalar subqueries for the scope and the leaders,
and array/struct expressions for the ordered, de-duplicated lists. The
result is one row; nothing is collected.

Row windows vs calendar windows: "last 7 / prior 7 / last 30 / prior 30"
count day ROWS (days without data are skipped); the KPI window, the previous
leader and the live report's corridor shift use CALENDAR days.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portflow.functions.fmt import compact, py_fixed, py_round_scaled, signed_pct
from portflow.functions.text import unicode_trim
from portflow.operators.panel_inputs import prepare_daily, prepare_ports, prepare_routes  # noqa: F401
from portflow.operators.panel_views import PanelViews, resolve_lookback

# Rule thresholds of the notable-change detector.
DELTA_THRESHOLD_PCT = 5.0
CONCENTRATION_THRESHOLD_PCT = 45.0
MIN_RECENT_AVG_PASSENGERS = 1000.0
# Severity / direction cut-offs.
DIRECTION_TOLERANCE_PCT = 1.0
WATCH_PCT, ALERT_PCT = 10.0, 20.0
CONC_WATCH_PCT, CONC_ALERT_PCT = 30.0, 45.0
CONGESTION_WATCH, CONGESTION_ALERT = 75.0, 90.0
STALE_AFTER_HOURS = 48
REPORT_TITLE = "Harbor Intelligence Report Card"
DEFAULT_NOW = _dt.datetime(2026, 1, 3, 0, 0, 0)


def py_round(x: Column, k: int) -> Column:
    """Python ``round(x, k)`` (half-even on the exact binary value)."""
    return py_round_scaled(x, k).cast("double") / float(10**k)


def _label_date(d: Column) -> Column:
    return F.date_format(d, "dd MMM yyyy")


def _ranked(daily_p: DataFrame) -> DataFrame:
    # Day grain: the newest-first row number over all days of the view is small.
    return daily_p.withColumn("rn", F.row_number().over(Window.orderBy(F.col("service_date").desc())))


# --- PAN-A: notable change ---------------------------------------------------------------------

def notable_change(daily: DataFrame, routes: DataFrame, delta_threshold_pct: float = DELTA_THRESHOLD_PCT,
                   concentration_threshold_pct: float = CONCENTRATION_THRESHOLD_PCT,
                   min_recent_avg_passengers: float = MIN_RECENT_AVG_PASSENGERS) -> DataFrame:
    """One row: ``should_trigger`` and the ``reasons`` array."""
    r = _ranked(prepare_daily(daily))
    p = F.col("total_passengers").cast("double")
    trend = r.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("rn") <= 7, p)).alias("recent"),
        F.avg(F.when(F.col("rn").between(8, 14), p)).alias("prior"),
    )
    known = routes.where(F.col("departure_port").isNotNull() & F.col("arrival_port").isNotNull())
    conc = known.groupBy("departure_port", "arrival_port").agg(
        F.coalesce(F.sum("total_passengers"), F.lit(0)).alias("p")
    ).agg(F.struct(F.max("p").alias("top"), F.sum("p").alias("total"))).scalar()
    trend = trend.select("*", conc.getField("top").alias("c_top"), conc.getField("total").alias("c_total"))
    reasons = _notable_reasons(F.col("n"), F.col("recent"), F.col("prior"), F.col("c_top"), F.col("c_total"),
                               delta_threshold_pct, concentration_threshold_pct, min_recent_avg_passengers)
    return trend.select(reasons.alias("reasons")).select((F.size("reasons") > 0).alias("should_trigger"), "reasons")


def _notable_reasons(n: Column, recent: Column, prior: Column, top: Column, total: Column, delta_threshold_pct: float = DELTA_THRESHOLD_PCT,
                     concentration_threshold_pct: float = CONCENTRATION_THRESHOLD_PCT,
                     min_recent_avg_passengers: float = MIN_RECENT_AVG_PASSENGERS) -> Column:
    delta = (recent - prior) / prior * 100.0
    share = top.cast("double") / total.cast("double") * 100.0
    r1 = F.when(
        (n >= 14) & (prior > 0) & (F.abs(delta) >= delta_threshold_pct) & (recent >= min_recent_avg_passengers),
        F.concat(F.lit("7-day passenger average changed "), signed_pct(delta, 1), F.lit(" vs prior week")),
    )
    r2 = F.when(
        (F.coalesce(total, F.lit(0)) > 0) & (share >= concentration_threshold_pct),
        F.concat(F.lit("Top corridor concentration reached "), py_fixed(share, 1), F.lit("%")),
    )
    return F.array_compact(F.array(r1, r2))


# --- PAN-C … PAN-H: scope, KPIs, leaders, deltas ------------------------------------------------

def _scope(view_start: Column, end: Column, n: int) -> list[Column]:
    """KPI window (n calendar days to the newest one), baseline and labels, as text."""
    kpi_start = F.greatest(view_start, F.date_sub(end, n - 1))
    b_end = F.date_sub(kpi_start, 1)
    has = b_end >= view_start
    b_start = F.when(has & (F.date_sub(b_end, 55) >= view_start), F.date_sub(b_end, 55)).otherwise(view_start)
    empty = end.isNull()
    current = F.concat(_label_date(kpi_start), F.lit(" -> "), _label_date(end))
    return [
        F.when(empty, "unknown").when(has, b_start.cast("string")).otherwise(view_start.cast("string")).alias("baseline_start"),
        F.when(empty, "unknown").when(has, b_end.cast("string")).otherwise(view_start.cast("string")).alias("baseline_end"),
        F.when(empty, "unknown").otherwise(kpi_start.cast("string")).alias("kpi_start"),
        F.when(empty, "unknown").otherwise(end.cast("string")).alias("kpi_end"),
        F.when(empty | ~has, "No comparison baseline available")
        .otherwise(F.concat(_label_date(b_start), F.lit(" -> "), _label_date(b_end))).alias("baseline_label"),
        F.when(empty, "No current period available").otherwise(F.concat(F.lit("Current period: "), current)).alias("kpi_label"),
        F.when(empty, "No data").otherwise(F.concat(F.lit("Global network | Report period "), current)).alias("scope_label"),
    ]


def panel_scope(daily: DataFrame, kpi_window_days: int = 7) -> DataFrame:
    """PAN-C: KPI window (n ≥ 7 calendar days to the newest day), baseline and labels."""
    d = F.col("service_date")
    ends = prepare_daily(daily).agg(F.min(d).alias("view_start"), F.max(d).alias("view_end"))
    return ends.select(*_scope(F.col("view_start"), F.col("view_end"), max(7, int(kpi_window_days))))


def _kpi_columns(n: int) -> list[Column]:
    """PAN-D from a view's ordered pass; a view without days has zeros."""
    nr, peak = F.coalesce(F.col("n_rows"), F.lit(0)), F.col("reference_peak")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    cong = F.when(peak > 0, F.least(F.col("recent_rows_avg") / peak * 100.0, F.lit(100.0))).otherwise(0.0)
    return [
        nr.alias("n_rows"), *[count(c) for c in ("passengers", "vehicles", "traffic_rows", "active_corridors")],
        cong.alias("congestion_raw"),
        F.coalesce(F.col("r7"), F.lit(0.0)).alias("recent_7d"),
        F.when(nr >= 14, F.col("p7")).alias("prior_7d"),
        F.when(nr >= 30, F.col("r30")).alias("recent_30d"),
        F.when(nr >= 60, F.col("p30")).alias("prior_30d"),
        F.coalesce(F.col("rn_"), F.lit(0.0)).alias("recent_window"),
        F.when(nr >= 2 * n, F.col("pn_")).alias("prior_window"),
    ]


def _published() -> list[Column]:
    """The KPI block as published (rounded like the source document)."""
    return [
        F.col("passengers"), F.col("vehicles"), F.col("traffic_rows"), F.col("active_corridors"),
        py_round(F.col("congestion_raw"), 1).alias("congestion_index_pct"),
        *[py_round(F.col(c), 1).alias(f"{c}_avg_passengers") for c in ("recent_7d", "prior_7d", "recent_30d", "prior_30d")],
    ]


def panel_kpis(daily: DataFrame, routes: DataFrame, kpi_window_days: int = 7) -> DataFrame:
    """PAN-D: the KPI block as published."""
    views = PanelViews(daily, kpi_window_days=kpi_window_days)
    rows = views.table().join(views.day_part(), "ord", "left").join(views.corridor_counts(routes, False), "ord", "left")
    return rows.select(*_kpi_columns(views.n)).select(*_published())


def _shared(leaders: Column, total: Column) -> Column:
    """Leaders with their share of the window's passengers."""
    share = lambda c: F.when(total > 0, c["passengers"].cast("double") / total.cast("double") * 100.0).otherwise(0.0)
    return F.transform(leaders, lambda c: F.struct(
        c["rank"].alias("rank"), c["pair_label"].alias("pair_label"), c["passengers"].alias("passengers"),
        c["vehicles"].alias("vehicles"), py_round(share(c), 1).alias("share_pct")))


def panel_top_corridors(daily: DataFrame, routes: DataFrame, kpi_window_days: int = 7) -> DataFrame:
    """PAN-E: top 5 corridors of the KPI window, share of the window's passengers."""
    views = PanelViews(daily, kpi_window_days=kpi_window_days)
    rows = views.corridor_lists(routes, False).join(views.day_part().select("ord", "passengers"), "ord", "left")
    return rows.select(F.inline(_shared(F.col("leaders"), F.coalesce("passengers", F.lit(0)))))


def panel_top_ports(daily: DataFrame, ports: DataFrame, kpi_window_days: int = 7) -> DataFrame:
    """PAN-F: top 5 ports by departing + arriving passengers, name as tie-break."""
    return PanelViews(daily, kpi_window_days=kpi_window_days).port_list(ports).select(F.inline("top_ports"))


def panel_prev_top(daily: DataFrame, routes: DataFrame) -> DataFrame:
    """PAN-G: leading corridor of calendar days end−13 … end−7 (NULL when none)."""
    views = PanelViews(daily)
    return views.table().join(views.corridor_lists(routes, False), "ord", "left").select("previous_top_corridor_label")


def _delta(name: str, label: str, period: str, cur: Column, prev: Column) -> Column:
    pct = F.when(cur.isNotNull() & prev.isNotNull() & (prev > 0), (cur - prev) / prev * 100.0)
    a = F.abs(pct)
    return F.struct(
        F.lit(name).alias("name"), F.lit(label).alias("label"), F.lit(period).alias("period"),
        F.when(pct.isNull(), "unknown").when(pct > DIRECTION_TOLERANCE_PCT, "up")
        .when(pct < -DIRECTION_TOLERANCE_PCT, "down").otherwise("flat").alias("direction"),
        F.when(pct.isNull(), "info").when(a >= ALERT_PCT, "alert").when(a >= WATCH_PCT, "watch").otherwise("info").alias("severity"),
        pct.alias("value_pct"),
        F.when(pct.isNull(), F.lit(f"{label}: insufficient history for a {period} comparison."))
        .otherwise(F.concat(F.lit(f"{label}: "), signed_pct(pct, 1), F.lit(f" versus the prior {period}."))).alias("summary"),
    )


def _deltas(n: int) -> Column:
    if n >= 90:
        return F.array(_delta("passengers_window_avg", f"{n}-day average passengers", f"{n}-day window",
                              F.col("recent_window"), F.col("prior_window")))
    return F.array(
        _delta("passengers_7d_avg", "7-day average passengers", "7-day window", F.col("recent_7d"), F.col("prior_7d")),
        _delta("passengers_30d_avg", "30-day average passengers", "30-day window", F.col("recent_30d"), F.col("prior_30d")),
    )


def _dedup(arr: Column, field: str, cap: int) -> Column:
    """Drop NULL entries, keep the first entry per ``field`` value, cap the length."""
    nn = F.filter(arr, lambda x: x.isNotNull())
    first = F.filter(nn, lambda x, i: ~F.exists(F.slice(nn, 1, i), lambda y: y[field] == x[field]))
    return F.slice(first, 1, cap)


def panel_context(daily: DataFrame, routes: DataFrame, ports: DataFrame, kpi_window_days: int = 7) -> DataFrame:
    """The whole source document of the frames as they are, as one row of typed columns (PAN-C … PAN-J)."""
    return panel_contexts(PanelViews(daily, kpi_window_days=kpi_window_days), routes, ports)


def panel_contexts(views: PanelViews, routes: DataFrame, ports: DataFrame) -> DataFrame:
    """One source document a view, as a row of typed columns, in one pass over each frame.

    Beside the document's parts: ``ord`` and ``lookback`` of the view, its
    ``data_version`` (PAN-O) and ``should_trigger`` (PAN-A).
    """
    n = views.n
    rows = views.table()
    for part in (views.day_part(), views.corridor_lists(routes), views.corridor_counts(routes), views.port_list(ports)):
        rows = rows.join(part, "ord", "left")  # a row a view
    version = F.when(F.col("n_rows").isNull(), "empty").otherwise(_version_text(
        F.col("newest"), F.col("rows_sum"), F.col("pax_sum"), F.coalesce("digest", F.lit("none"))))
    base = rows.select(
        "ord", "lookback", *_kpi_columns(n), F.struct(*_scope(F.col("view_start"), F.col("newest"), n)).alias("scope"),
        F.coalesce(_shared(F.col("leaders"), F.coalesce("passengers", F.lit(0))), F.array()).alias("top_corridors"),
        F.coalesce("top_ports", F.array()).alias("top_ports"), "previous_top_corridor_label", version.alias("data_version"),
        _notable_reasons(F.coalesce("n_rows", F.lit(0)), F.col("r7"), F.col("p7"), F.col("c_top"), F.col("c_total")).alias("notable_change_reasons"),
    ).withColumn("should_trigger", F.size("notable_change_reasons") > 0).withColumn("deltas", _deltas(n))

    top = F.get(F.col("top_corridors"), 0)
    port = F.get(F.col("top_ports"), 0)
    share = top["share_pct"]
    cong1 = py_round(F.col("congestion_raw"), 1)
    prev_c = F.col("previous_top_corridor_label")
    has_prev = prev_c.isNotNull() & (prev_c != "")
    sig = lambda kind, sev, summary: F.struct(kind.alias("kind"), sev.alias("severity"), summary.alias("summary"))
    delta_signals = F.transform("deltas", lambda d: sig(d["name"], d["severity"], d["summary"]))
    extra = F.array(
        F.when(top.isNotNull(), sig(
            F.lit("corridor_concentration"),
            F.when(share >= CONC_ALERT_PCT, "alert").when(share >= CONC_WATCH_PCT, "watch").otherwise("info"),
            F.concat(F.lit("Top corridor concentration: "), top["pair_label"], F.lit(" carries "), py_fixed(share, 1),
                     F.lit("% of current-period passengers.")))),
        F.when(top.isNotNull() & has_prev, sig(
            F.lit("corridor_shift"),
            F.when(prev_c == top["pair_label"], "info").otherwise("watch"),
            F.when(prev_c == top["pair_label"],
                   F.concat(F.lit("Corridor leader is stable: "), top["pair_label"],
                            F.lit(" remains first across the last two weekly windows.")))
            .otherwise(F.concat(F.lit("Corridor rotation detected: leader moved from "), prev_c, F.lit(" to "),
                                top["pair_label"], F.lit(" in the latest weekly window."))))),
        sig(F.lit("congestion"),
            F.when(cong1 >= CONGESTION_ALERT, "alert").when(cong1 >= CONGESTION_WATCH, "watch").otherwise("info"),
            F.concat(F.lit("Congestion index is "), py_fixed(cong1, 0),
                     F.lit("% versus the 95th percentile traffic-row baseline."))),
    )
    sig_raw = F.concat(delta_signals, extra)

    act = lambda a, r, p: F.struct(a.alias("action"), F.lit(r).alias("rationale"), F.lit(p).alias("priority"))
    primary = F.get(F.col("deltas"), 0)["value_pct"]
    rotation = top.isNotNull() & has_prev & (prev_c != top["pair_label"])
    candidates = F.array(
        F.when(primary <= -20, act(
            F.concat(F.lit("Investigate the demand drop on "), F.coalesce(top["pair_label"], F.lit("the leading corridors")), F.lit(".")),
            "A large weekly contraction can reflect schedule suppression, displaced demand, or data latency that needs confirmation before action.",
            "investigate"))
        .when(primary >= 20, act(
            F.concat(F.lit("Validate berth and vessel capacity around "), F.coalesce(port["port_name"], F.lit("the busiest ports")), F.lit(".")),
            "A sharp weekly expansion can create staffing and berth pressure if it persists into the next reporting window.",
            "investigate")),
        F.when(top.isNotNull() & (share >= 45), act(
            F.concat(F.lit("Review concentration risk on "), top["pair_label"], F.lit(".")),
            "High corridor concentration increases operational sensitivity to one route's schedule changes or reporting gaps.",
            "escalate")),
        F.when(rotation, act(
            F.concat(F.lit("Confirm the corridor rotation into "), top["pair_label"], F.lit(".")),
            "A new lead corridor should be checked against schedule changes and recent demand redistribution before it is treated as a durable shift.",
            "monitor")),
    )
    fallback = F.array(act(
        F.concat(F.lit("Monitor the next ingestion window for "), F.coalesce(port["port_name"], F.lit("the network")), F.lit(".")),
        "The current snapshot does not justify escalation, but the next update should confirm whether recent demand patterns persist or revert.",
        "monitor"))
    act_raw = candidates
    empty_actions = F.array(act(
        F.lit("Validate upstream ingestion before publishing commentary."),
        "The reporting snapshot is empty, so any narrative would be unreliable.", "escalate"))
    empty = F.col("n_rows") == 0
    # Stage the raw lists as columns first: the de-duplication references its
    # input several times, and columns keep the generated code small.
    staged = base.select("*", sig_raw.alias("_sig_raw"), act_raw.alias("_act_raw"), fallback.alias("_act_fallback"))
    chosen = F.filter("_act_raw", lambda x: x.isNotNull())
    staged = staged.withColumn("_act_chosen", F.when(F.size(chosen) > 0, chosen).otherwise(F.col("_act_fallback")))
    signals = _dedup(F.col("_sig_raw"), "summary", 8)
    actions = _dedup(F.col("_act_chosen"), "action", 4)
    return staged.select(
        "*",
        F.when(empty, F.array().cast("array<struct<kind:string,severity:string,summary:string>>")).otherwise(signals).alias("signals"),
        F.when(empty, empty_actions).otherwise(actions).alias("action_candidates"),
    ).drop("_sig_raw", "_act_raw", "_act_fallback", "_act_chosen").withColumn(
        "deltas", F.when(empty, F.filter("deltas", lambda x: F.lit(False))).otherwise(F.col("deltas")))


def panel_deltas(ctx: DataFrame) -> DataFrame:
    """PAN-H: one row per delta, in order."""
    return ctx.select(F.posexplode("deltas").alias("pos", "d")).select(
        (F.col("pos") + 1).alias("ord"), "d.name", "d.label", "d.period", "d.direction", "d.severity", "d.value_pct", "d.summary"
    )


def panel_signals(ctx: DataFrame) -> DataFrame:
    """PAN-I: ordered, de-duplicated signals (≤ 8)."""
    return ctx.select(F.posexplode("signals").alias("pos", "s")).select(
        (F.col("pos") + 1).alias("ord"), "s.kind", "s.severity", "s.summary")


def panel_actions(ctx: DataFrame) -> DataFrame:
    """PAN-J: ordered, de-duplicated action candidates (≤ 4)."""
    return ctx.select(F.posexplode("action_candidates").alias("pos", "a")).select(
        (F.col("pos") + 1).alias("ord"), "a.action", "a.rationale", "a.priority")


def panel_source_json(ctx: DataFrame) -> DataFrame:
    """PAN-K: the source document ``auto_panel_source_v2`` as JSON (list caps 5/5/6/8/4/4)."""
    return ctx.select(_source_json().alias("source_snapshot_json"))


def _source_json() -> Column:
    k = F.struct(*_published())
    doc = F.struct(
        F.lit("auto_panel_source_v2").alias("schema_version"),
        F.col("scope"),
        k.alias("kpis"),
        F.transform(F.slice("top_corridors", 1, 5), lambda c: F.struct(
            c["pair_label"].alias("pair_label"), c["passengers"].alias("passengers"), c["vehicles"].alias("vehicles"),
            c["share_pct"].alias("share_pct"))).alias("top_corridors"),
        F.transform(F.slice("top_ports", 1, 5), lambda p: F.struct(
            p["port_name"].alias("port_name"), p["passengers"].alias("passengers"))).alias("top_ports"),
        F.slice("deltas", 1, 6).alias("deltas"),
        F.slice("signals", 1, 8).alias("signals"),
        F.slice("action_candidates", 1, 4).alias("action_candidates"),
        F.col("previous_top_corridor_label"),
        F.slice("notable_change_reasons", 1, 4).alias("notable_change_reasons"),
    )
    return F.to_json(doc, {"ignoreNullFields": "false"})


# --- PAN-L: rendered report card ------------------------------------------------------------------

def _clean_list(arr: Column, cap: int) -> Column:
    """Trim items, drop empty ones, cap the length."""
    return F.slice(F.filter(F.transform(arr, lambda x: F.trim(x)), lambda x: x != ""), 1, cap)


def panel_report(ctx: DataFrame, with_source_json: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """PAN-L: the deterministic report card (title, summary, lists, text); ``keep`` names further columns to carry along."""
    top = F.get(F.col("top_corridors"), 0)
    port = F.get(F.col("top_ports"), 0)
    cong1 = py_round(F.col("congestion_raw"), 1)
    weekly = F.get(F.filter("deltas", lambda d: d["name"] == "passengers_7d_avg"), 0)
    monthly = F.get(F.filter("deltas", lambda d: d["name"] == "passengers_30d_avg"), 0)
    wv = weekly["value_pct"]
    outlook = (
        F.when(weekly.isNull() | wv.isNull(), "Hold the current view until another reporting window lands.")
        .when(wv >= 8, "Expect demand to stay firm or edge higher in the next reporting window unless the spike reverses quickly.")
        .when(wv <= -8, "Expect a soft patch in the next reporting window unless this week's drop proves to be temporary.")
        .otherwise("Expect broadly stable movement in the next reporting window.")
    )
    summary = F.concat(
        F.lit("Current period: "), compact(F.col("passengers")), F.lit(" passengers and "), compact(F.col("vehicles")),
        F.lit(" vehicles. Congestion held at "), py_fixed(cong1, 0), F.lit("% of baseline."),
        F.coalesce(F.concat(F.lit(" "), top["pair_label"], F.lit(" led with "), py_fixed(top["share_pct"], 1),
                            F.lit("% of traffic.")), F.lit("")),
        F.coalesce(F.concat(F.lit(" "), port["port_name"], F.lit(" remained the busiest port.")), F.lit("")),
    )
    facts = F.filter(F.array(
        F.concat(F.lit("Comparison baseline: "), F.col("scope.baseline_label"), F.lit(".")),
        F.concat(F.lit("Traffic rows in the current period: "), compact(F.col("traffic_rows")), F.lit(" across "),
                 F.col("active_corridors").cast("string"), F.lit(" active corridors.")),
        F.when(top.isNotNull(), F.concat(F.lit("Top corridor "), top["pair_label"], F.lit(" carried "), compact(top["passengers"]),
                                         F.lit(" passengers ("), py_fixed(top["share_pct"], 1), F.lit("% share)."))),
        F.when(port.isNotNull(), F.concat(F.lit("Top port "), port["port_name"], F.lit(" handled "), compact(port["passengers"]),
                                          F.lit(" passengers."))),
    ), lambda x: x.isNotNull())
    flagged = F.transform(F.filter("signals", lambda s: s["severity"].isin("watch", "alert")), lambda s: s["summary"])
    anomalies = F.when(F.size(flagged) > 0, F.slice(flagged, 1, 3)).otherwise(
        F.slice(F.transform("signals", lambda s: s["summary"]), 1, 1))
    comparisons = F.slice(F.filter(F.transform("deltas", lambda d: d["summary"]), lambda x: x.isNotNull() & (x != "")), 1, 3)
    action0 = F.get(F.col("action_candidates"), 0)
    recs = F.filter(F.array(action0["action"], F.concat(F.lit("Outlook: "), outlook)), lambda x: x.isNotNull())
    prev_c = F.col("previous_top_corridor_label")
    parts = F.filter(F.array(
        weekly["summary"],
        F.when(monthly.isNotNull() & monthly["value_pct"].isNotNull(), monthly["summary"]),
        F.when(top.isNotNull() & prev_c.isNotNull() & (prev_c != ""),
               F.when(top["pair_label"] == prev_c,
                      F.concat(F.lit("Route leadership remains anchored on "), top["pair_label"], F.lit(".")))
               .otherwise(F.concat(F.lit("Route leadership rotated from "), prev_c, F.lit(" to "), top["pair_label"], F.lit(".")))),
        outlook,
    ), lambda x: x.isNotNull())
    return ctx.select(
        *keep,
        F.lit(REPORT_TITLE).alias("title"),
        summary.alias("summary"),
        _clean_list(facts, 4).alias("facts"),
        _clean_list(anomalies, 3).alias("anomalies"),
        _clean_list(comparisons, 3).alias("comparisons"),
        _clean_list(recs, 3).alias("recommendations"),
        F.array_join(parts, " ").alias("report_text"),
        F.when(action0.isNotNull(), F.concat(F.lit("Recommended action rationale: "), action0["rationale"]))
        .otherwise(F.lit("Recommended action rationale unavailable.")).alias("insight_text"),
        *([_source_json().alias("source_snapshot_json")] if with_source_json else []),
    )


# --- PAN-O / PAN-P: data version and filter hash ----------------------------------------------------

def py_data_version(daily: DataFrame, routes: DataFrame | None) -> DataFrame:
    """PAN-O: ``max date|rows:n|pax:n|top:<sha256(top-5 digest)[:16]>``, 'empty' without day rows.

    Sums are truncated to integers; the digest joins ``dep->arr:passengers``
    (no spaces) of the top 5 corridors and is 'none' when there are none.
    """
    dp = prepare_daily(daily)
    if routes is not None:
        rp = prepare_routes(routes)
        order = [F.col("p").desc(), F.col("departure_port").asc(), F.col("arrival_port").asc()]
        top5 = rp.groupBy("departure_port", "arrival_port").agg(F.sum("total_passengers").alias("p")).orderBy(*order).limit(5)
        item = F.struct((-F.col("p")).alias("k1"), F.col("departure_port").alias("k2"), F.col("arrival_port").alias("k3"),
                        F.concat(F.col("departure_port"), F.lit("->"), F.col("arrival_port"), F.lit(":"),
                                 F.col("p").cast("long").cast("string")).alias("s"))
        digest = top5.agg(
            F.when(F.count(F.lit(1)) > 0, F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["s"]), "|"))
            .otherwise(F.lit("none"))
        ).scalar()
    else:
        digest = F.lit("none")
    agg = dp.agg(F.max("service_date").alias("mx"), F.count(F.lit(1)).alias("n"),
                 F.sum("rows_count").alias("rows"), F.sum("total_passengers").alias("pax"))
    return agg.select(
        F.when(F.col("n") == 0, F.lit("empty")).otherwise(_version_text(F.col("mx"), F.col("rows"), F.col("pax"), digest)).alias("data_version")
    )


def _version_text(newest: Column, rows: Column, pax: Column, digest: Column) -> Column:
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long").cast("string")
    return F.concat(newest.cast("string"), F.lit("|rows:"), whole(rows), F.lit("|pax:"), whole(pax), F.lit("|top:"),
                    F.substring(F.sha2(digest, 256), 1, 16))


def filter_hash(filters: Column) -> Column:
    """PAN-P: sha256 of the filters as compact ASCII JSON, first 16 hex.

    Characters beyond ASCII are escaped as four hexadecimal digits (a pair of
    them beyond the basic plane). ``filters`` is a struct; its fields must be
    in sorted key order (see ``sorted_struct``).
    """
    return F.substring(F.sha2(ascii_json(F.to_json(filters)), 256), 1, 16)


def sorted_struct(**fields: Column) -> Column:
    """A struct with its fields in key order."""
    return F.struct(*[fields[k].alias(k) for k in sorted(fields)])


def ascii_json(text: Column) -> Column:
    """JSON text with every character beyond ASCII written as ``\\uXXXX``."""

    def escaped(unit: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(unit)), 4, "0"))

    def one(c: Column) -> Column:
        point = F.ascii(c)
        low = point - 0x10000
        pair = F.concat(escaped((low / 1024).cast("int") + 0xD800), escaped(F.pmod(low, F.lit(1024)) + 0xDC00))
        return F.when(point < 128, c).when(point < 0x10000, escaped(point)).otherwise(pair)

    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substr(text, i, F.lit(1)))
    return F.when(F.length(text) > 0, F.array_join(F.transform(chars, one), "")).otherwise(text)


# --- PAN-L row, PAN-Q … PAN-T: the snapshot table ------------------------------------------------------

def panel_snapshot_row(ctx: DataFrame, snapshot_ts: Column | None = None) -> DataFrame:
    """The auto-panel row of the snapshot table for each row of the context (deterministic rendering).

    Narrative generation by an external model is not part of this build: a
    notable change is recorded as the deterministic fallback the reference
    writes when no provider is configured.
    """
    ts = snapshot_ts if snapshot_ts is not None else F.lit(DEFAULT_NOW).cast("timestamp_ntz")
    # Report and source document from ONE pass over the context.
    rep = panel_report(ctx, with_source_json=True, keep=("data_version", "should_trigger"))
    notable = F.col("should_trigger")
    null_s = F.lit(None).cast("string")
    return rep.select(
        ts.alias("snapshot_ts"), F.lit("agent_panel").alias("chart_id"), F.lit("auto_panel").alias("insight_type"),
        F.lit("weekly").alias("grain"), null_s.alias("filter_hash"), "data_version", "title", "summary",
        "facts", "anomalies", "comparisons", "recommendations", "report_text", "insight_text",
        F.when(notable, "deterministic_no_api_key").otherwise("deterministic_skip").alias("generation_mode"),
        F.when(notable, F.lit("LLM provider API key not set")).otherwise(null_s).alias("generation_error"),
        null_s.alias("model_name"), "source_snapshot_json", null_s.alias("overlay_json"),
    )


def snapshot_lookup(snapshots: DataFrame, chart_id: Column, data_version: Column, filter_hash_value: Column,
                    insight_type: Column | None = None) -> DataFrame:
    """PAN-Q: exact filter-hash match first, then a NULL-hash row; newest first; one row."""
    cond = (F.col("chart_id") == chart_id) & (F.col("data_version") == data_version) & (
        (F.col("filter_hash") == filter_hash_value) | F.col("filter_hash").isNull())
    if insight_type is not None:
        cond = cond & (F.col("insight_type") == insight_type)
    rank = F.when(F.col("filter_hash") == filter_hash_value, 0).when(F.col("filter_hash").isNull(), 1).otherwise(2)
    return snapshots.where(cond).orderBy(rank, F.col("snapshot_ts").desc()).limit(1)


def snapshot_latest(snapshots: DataFrame, chart_id: Column, insight_type: Column | None = None) -> DataFrame:
    """PAN-R: newest snapshot of a chart, any data version."""
    cond = F.col("chart_id") == chart_id
    if insight_type is not None:
        cond = cond & (F.col("insight_type") == insight_type)
    return snapshots.where(cond).orderBy(F.col("snapshot_ts").desc()).limit(1)


def snapshot_answers(snapshots: DataFrame, requests: DataFrame) -> DataFrame:
    """PAN-Q/R for a table of requests: the row a panel shows for each, in one as-of join.

    ``requests``: request_id, chart_id, insight_type (NULL: any), data_version,
    filter_hash. In order: a row of the version with the filter hash
    (``match`` is ``exact``), one of the version without a hash
    (``unfiltered``), the newest of any version (``latest``); the newest row
    within each, ties to the smaller insight type, version and hash. A request
    that finds nothing has a row with NULLs.

    A snapshot can answer under six keys (three levels, with its insight type
    or any); only the newest one a key leaves its task, by map-side combine, so
    charts with any number of versions ship one narrow row a key and task.
    Requests look their three keys up by an equi-join, and only the chosen rows
    are fetched whole.
    """
    value, any_value = lambda c: F.concat(F.lit("="), F.col(c)), F.lit("*")

    def keys(of_row: bool) -> Column:
        """(level, insight, version, hash) under which a snapshot answers, or which a request asks for."""
        version, hashed = value("data_version"), value("filter_hash")
        insights = [value("insight_type"), any_value] if of_row else [F.coalesce(value("insight_type"), any_value)]
        bare = F.col("filter_hash").isNull() if of_row else F.lit(True)
        levels = [(0, version, hashed, hashed.isNotNull()), (1, version, any_value, bare), (2, any_value, any_value, F.lit(True))]
        return F.explode(F.array_compact(F.array(*[
            F.when(fits, F.struct(F.lit(level).alias("level"), i.alias("insight"), v.alias("version"), h.alias("hash")))
            for level, v, h, fits in levels for i in insights
        ])))

    key = ["chart_id", "k.level", "k.insight", "k.version", "k.hash"]
    who = F.struct("insight_type", "data_version", "filter_hash", "snapshot_ts")
    # the newest, ties to the smallest names: the least of (age, names)
    age = F.struct((-F.unix_micros(F.col("snapshot_ts").cast("timestamp"))).alias("age"), F.col("insight_type").alias("i"),
                   F.col("data_version").alias("v"), F.col("filter_hash").alias("h"))
    newest = snapshots.select("chart_id", keys(True).alias("k"), who.alias("who"), age.alias("age"))
    newest = newest.groupBy(*key).agg(F.min_by("who", "age").alias("who"))
    asked = requests.select("request_id", "chart_id", keys(False).alias("k")).select("request_id", *key)
    found = asked.join(newest, ["chart_id", "level", "insight", "version", "hash"])
    best = found.groupBy("request_id", "chart_id").agg(F.min(F.struct("level", "who")).alias("b"))
    best = best.select("request_id", F.col("chart_id").alias("_c"), "b.level", F.col("b.who").alias("_w"))
    same = (snapshots["chart_id"] == F.col("_c")) & (snapshots["snapshot_ts"] == F.col("_w.snapshot_ts"))
    for c in ("insight_type", "data_version", "filter_hash"):
        same = same & snapshots[c].eqNullSafe(F.col(f"_w.{c}"))
    rows = best.join(snapshots, same).dropDuplicates(["request_id"]).drop("_c", "_w")
    match = F.when(F.col("level") == 0, "exact").when(F.col("level") == 1, "unfiltered").when(F.col("level") == 2, "latest")
    return requests.select("request_id").join(rows, "request_id", "left").withColumn("match", match).drop("level")


def snapshot_freshness(snapshots: DataFrame, now: Column, chart_id: str = "agent_panel", insight_type: str = "auto_panel",
                       stale_after_hours: float = STALE_AFTER_HOURS) -> DataFrame:
    """PAN-S: hours since the newest matching snapshot; stale when none or older than the limit."""
    latest = snapshots.where((F.col("chart_id") == chart_id) & (F.col("insight_type") == insight_type)).agg(
        F.max("snapshot_ts").alias("latest_snapshot_ts"))
    hours = (F.unix_micros(F.to_timestamp(now.cast("string"))) - F.unix_micros(F.to_timestamp(F.col("latest_snapshot_ts").cast("string")))) / 3.6e9
    return latest.select(
        "latest_snapshot_ts", hours.alias("hours_since_latest"),
        (F.col("latest_snapshot_ts").isNull() | (hours > stale_after_hours)).alias("is_stale"),
    )


def snapshot_lines(snapshots: DataFrame) -> DataFrame:
    """PAN-T: display lines per snapshot row, plus KPI dates and scope label from the JSON.

    Panel rows: summary (unless an overlay), report text if different (an
    overlay's text in its blocks), 'Action: ' + first recommendation, the
    second recommendation. Other rows: a report text that holds the four
    headings gives its blocks alone; else summary, report text (not for
    deepen rows), insight text, then the four lists. Blocks are separated by
    empty lines; lines are trimmed, empty ones dropped, repeats kept once. A
    NULL text counts as empty.
    """
    empty = F.array().cast("array<string>")

    def t(c: Column) -> Column:
        return unicode_trim(F.coalesce(c, F.lit("")))

    def keep(arr: Column) -> Column:
        return F.array_distinct(F.filter(arr, lambda x: x != ""))

    def blocks(c: Column) -> Column:
        return F.filter(F.transform(F.split(c, "\n\n"), t), lambda x: x != "")

    def lines(c: str) -> Column:
        return F.coalesce(F.transform(F.col(c), t), empty)

    summary, report, insight = t(F.col("summary")), t(F.col("report_text")), t(F.col("insight_text"))
    low = F.lower(report)
    headed = low.contains("current state:") & low.contains("notable shifts:") & low.contains("anomaly call-out:") & low.contains("outlook:")
    lists = F.concat(*[lines(c) for c in ("facts", "anomalies", "comparisons", "recommendations")])
    deepen = F.coalesce(F.col("insight_type") == "deepen_chart", F.lit(False))
    generic = F.when(headed, blocks(report)).otherwise(
        keep(F.concat(F.array(summary, F.when(deepen, F.lit("")).otherwise(report), insight), lists)))
    recs = F.filter(lines("recommendations"), lambda x: x != "")
    overlay = t(F.col("generation_mode")) == "llm_overlay"
    first, second = F.coalesce(F.get(recs, 0), F.lit("")), F.coalesce(F.get(recs, 1), F.lit(""))
    action = F.when((first == "") | F.lower(first).startswith("action:"), first).otherwise(F.concat(F.lit("Action: "), first))
    told = F.when(report == summary, empty).when(overlay, blocks(report)).otherwise(F.array(report))
    panel = keep(F.when(overlay, told).otherwise(F.concat(F.array(summary), told, F.array(action, second))))
    is_panel = (F.col("chart_id") == "agent_panel") & (F.col("insight_type") == "auto_panel")
    return snapshots.select(
        "chart_id", "insight_type", "data_version", "snapshot_ts",
        F.when(is_panel, panel).otherwise(generic).alias("lines"),
        F.get_json_object("source_snapshot_json", "$.scope.kpi_start").alias("kpi_start"),
        F.get_json_object("source_snapshot_json", "$.scope.kpi_end").alias("kpi_end"),
        F.get_json_object("source_snapshot_json", "$.scope.scope_label").alias("scope_label"),
    )


def panel_rows(daily: DataFrame, routes: DataFrame, ports: DataFrame, lookbacks: list[str] | None = None, end_date: str | None = None,
               kpi_window_days: int = 7, snapshot_ts: Column | None = None) -> DataFrame:
    """PAN-U: one auto-panel row per lookback, as the scheduled writer stores them.

    The end is the newest day, or ``end_date`` if that is earlier; a lookback
    (``full``, ``year`` or days, at least 7; 90 by default) is clipped to the
    days there are. The lookbacks are nested views of one pass over each
    frame: nothing is stored, and more lookbacks read nothing more. Corridors
    are read without vehicles on this path, so vehicles are 0 and break no ties.
    """
    views = PanelViews(daily, lookbacks or ["90"], end_date, kpi_window_days)
    return panel_snapshot_row(panel_contexts(views, routes.drop("total_vehicles"), ports), snapshot_ts)


def panel_cache_match(lines: DataFrame, current_start: Column, current_end: Column, default_scope: Column) -> DataFrame:
    """PAN-V: reuse the cached panel when the default scope is shown and its KPI dates equal the current 7 days."""
    return lines.select(
        "chart_id", "data_version",
        (default_scope & (F.col("kpi_start").cast("date") == current_start) & (F.col("kpi_end").cast("date") == current_end))
        .alias("use_cached"),
    )


# --- PAN-M: live four-paragraph report -----------------------------------------------------------

def live_report(daily: DataFrame, routes: DataFrame, ports: DataFrame, view) -> DataFrame:
    """PAN-M: current state, notable shifts, anomaly call-out and outlook (4 rows, in order).

    KPI values come from the current 7-day window of the view, the baseline
    text from the baseline windows, the corridor shift from CALENDAR weeks
    (last 7 vs the 7 before) and the 7/30-day deltas from day ROWS.
    """
    from portflow.operators import analytics as N

    dv, rv, pv = view.apply(daily), view.apply(routes), view.apply(ports)
    wm = N.window_metrics(daily, routes, ports, view)
    cur = wm.where(F.col("window_index") == 0).agg(F.struct(
        F.first("window_start").alias("s"), F.first("window_end").alias("e"), F.first("pax").alias("pax"),
        F.first("veh").alias("veh"))).scalar()
    base = wm.where(F.col("window_index") >= 1).agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.min("window_start").alias("s"), F.max("window_end").alias("e"))).scalar()
    cur_v = N.View(cur.getField("s"), cur.getField("e"))
    top_c = N.top_corridors(cur_v.apply(rv), 1).agg(F.struct(
        F.first("pair_label").alias("label"), F.first("passengers").alias("pax"))).scalar()
    top_p = N.port_balance(cur_v.apply(pv), 1).agg(F.first("port_name")).scalar()
    cong = N.congestion_index(dv).select("congestion_index").scalar()

    r = _ranked(prepare_daily(dv))
    p = F.col("total_passengers").cast("double")
    t = r.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("rn") <= 7, p)).alias("r7"), F.avg(F.when(F.col("rn").between(8, 14), p)).alias("p7"),
        F.avg(F.when(F.col("rn") <= 30, p)).alias("r30"), F.avg(F.when(F.col("rn").between(31, 60), p)).alias("p30"),
    )
    known = rv.where(F.col("departure_port").isNotNull() & F.col("arrival_port").isNotNull())
    mx = rv.agg(F.max("service_date")).scalar()

    def leader(start, end):
        g = known.where(F.col("service_date").between(start, end)).groupBy("departure_port", "arrival_port").agg(
            F.sum("total_passengers").alias("p")).orderBy(F.col("p").desc(), "departure_port", "arrival_port").limit(1)
        return g.agg(F.first(F.concat(F.col("departure_port"), F.lit(" -> "), F.col("arrival_port")))).scalar()

    recent_top, prior_top = leader(F.date_sub(mx, 6), mx), leader(F.date_sub(mx, 13), F.date_sub(mx, 7))
    # Stage 1: every subquery-backed value becomes a plain column (formatting
    # below references its inputs many times; columns keep the plan small).
    t = t.select(
        F.when((F.col("n") >= 14) & (F.col("p7") > 0), (F.col("r7") - F.col("p7")) / F.col("p7") * 100.0).alias("d7"),
        F.when((F.col("n") >= 60) & (F.col("p30") > 0), (F.col("r30") - F.col("p30")) / F.col("p30") * 100.0).alias("d30"),
        cur.alias("cur"), base.alias("base"), top_c.alias("top_c"), top_p.alias("top_p"), cong.alias("cong"),
        recent_top.alias("recent_top"), prior_top.alias("prior_top"),
    ).select(
        "d7", "d30", "top_p", "recent_top", "prior_top",
        F.col("cur.s").alias("cs"), F.col("cur.e").alias("ce"),
        F.coalesce(F.col("cur.pax"), F.lit(0)).alias("pax"), F.coalesce(F.col("cur.veh"), F.lit(0)).alias("veh"),
        F.coalesce(F.col("base.n"), F.lit(0)).alias("bn"), F.col("base.s").alias("bs"), F.col("base.e").alias("be"),
        F.col("top_c.label").alias("top_label"), F.coalesce(F.col("top_c.pax"), F.lit(0)).alias("top_pax"),
        F.coalesce(F.col("cong"), F.lit(0.0)).alias("cong"),
    ).withColumn(
        "share", F.when(F.col("pax") > 0, F.col("top_pax").cast("double") / F.col("pax").cast("double") * 100.0).otherwise(0.0)
    )
    d7, d30, pax, veh, bn = F.col("d7"), F.col("d30"), F.col("pax"), F.col("veh"), F.col("bn")
    recent_top, prior_top = F.col("recent_top"), F.col("prior_top")
    period = F.concat(_label_date(F.col("cs")), F.lit(" -> "), _label_date(F.col("ce")))
    baseline = (
        F.when(bn >= 8, F.concat(bn.cast("string"), F.lit(" x 7-day windows: "), _label_date(F.col("bs")), F.lit(" -> "),
                                 _label_date(F.col("be"))))
        .when(bn >= 1, F.concat(_label_date(F.col("bs")), F.lit(" -> "), _label_date(F.col("be"))))
        .otherwise(F.lit("No comparison baseline available"))
    )
    p1 = F.concat(
        F.lit("Current period: "), period, F.lit(". The network recorded "), compact(pax, once=True), F.lit(" passengers and "),
        compact(veh, once=True), F.lit(" vehicles. The leading corridor is "), F.coalesce(F.col("top_label"), F.lit("No data")),
        F.lit(" ("), py_fixed(F.col("share"), 1, once=True), F.lit("% of scoped passengers), with "), F.coalesce(F.col("top_p"), F.lit("No data")),
        F.lit(" as the highest-flow port. Congestion index is "), py_fixed(F.col("cong"), 0, once=True),
        F.lit("%. Comparison baseline: "), baseline, F.lit("."),
    )
    weekly = F.when(d7.isNull(), F.lit("Not enough history for 7-day change.")).otherwise(
        F.concat(F.lit("7-day average passengers are "), signed_pct(d7, 1, once=True), F.lit(" vs prior week.")))
    monthly = F.when(d30.isNull(), F.lit("Not enough history for 30-day change.")).otherwise(
        F.concat(F.lit("30-day average passengers are "), signed_pct(d30, 1, once=True), F.lit(" vs prior 30-day window.")))
    shift = (
        F.when(recent_top.isNull() | prior_top.isNull(), F.lit("Route rank shift data unavailable."))
        .when(recent_top == prior_top, F.concat(F.lit("Top corridor remains "), recent_top, F.lit(" across the last two weekly windows.")))
        .otherwise(F.concat(F.lit("Top corridor shifted from "), prior_top, F.lit(" to "), recent_top, F.lit(" in the latest week.")))
    )
    p2 = F.concat(F.lit("Notable shifts: "), weekly, F.lit(" "), monthly, F.lit(" "), shift)
    p3 = F.concat(F.lit("Anomaly call-out: "), F.when(
        d7.isNotNull() & (F.abs(d7) >= 20),
        F.concat(F.lit("Traffic momentum moved "), signed_pct(d7, 1, once=True), F.lit(
            " week-over-week, which is a notable swing. Likely causes include schedule shifts, route substitution, or reporting lag."))
    ).otherwise(F.lit("No high-severity anomaly flag triggered in the current scope.")))
    hint = (
        F.when(d7.isNull(), F.lit("Direction is stable."))
        .when(d7 > 5, F.lit("Expect a mild upward drift over the next 7-14 days."))
        .when(d7 < -5, F.lit("Expect a mild downward normalization over the next 7-14 days."))
        .otherwise(F.lit("Expect relatively flat movement over the next 7-14 days."))
    )
    p4 = F.concat(F.lit("Outlook: "), hint, F.lit(
        " This is a short operational directional signal based on recent window behavior; re-check after the next ingestion snapshot."))
    return t.select(p1.alias("p1"), p2.alias("p2"), p3.alias("p3"), p4.alias("p4")).select(
        F.posexplode(F.array("p1", "p2", "p3", "p4")).alias("pos", "paragraph")
    ).select((F.col("pos") + 1).alias("ord"), "paragraph")


# --- PAN-U: presets ---------------------------------------------------------------------------------

def panel_presets(daily: DataFrame, routes: DataFrame, presets: list[str]) -> DataFrame:
    """PAN-U: per preset, the window clipped to the available days and its data version.

    Presets are nested windows ending on the newest day, so each day (and
    route row) is tagged with every preset that contains it — one pass, no
    range join — then aggregated per preset.
    """
    d = F.col("service_date")
    b = daily.agg(F.struct(F.min(d).alias("mn"), F.max(d).alias("mx"))).scalar()
    span = F.datediff(b.getField("mx"), b.getField("mn")) + 1
    items = []
    for i, token in enumerate(presets):
        lb = resolve_lookback(token, span)
        eff = F.least(lb, span)
        items.append(F.struct(F.lit(i + 1).alias("ord"), F.lit(token).alias("preset"), lb.alias("lookback_days"),
                              eff.alias("effective_days"), F.date_sub(b.getField("mx"), eff - 1).alias("start_date"),
                              b.getField("mx").alias("end_date")))
    arr = F.array(*items)

    def tag(df: DataFrame) -> DataFrame:
        # Project the preset list first (subqueries may not sit inside lambdas).
        return df.withColumn("_presets", arr).select(
            "*", F.explode(F.filter("_presets", lambda x: d >= x["start_date"])).alias("ps")).drop("_presets")

    dp = tag(prepare_daily(daily)).groupBy("ps").agg(
        F.count(F.lit(1)).alias("day_rows"), F.sum("rows_count").alias("rows_total"),
        F.sum("total_passengers").alias("passengers_total"))
    order = [F.col("p").desc(), F.col("departure_port").asc(), F.col("arrival_port").asc()]
    w = Window.partitionBy("ps").orderBy(*order)
    top = (tag(prepare_routes(routes)).groupBy("ps", "departure_port", "arrival_port").agg(F.sum("total_passengers").alias("p"))
           .withColumn("r", F.row_number().over(w)).where(F.col("r") <= 5))
    digest = top.groupBy("ps").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
        "r", F.concat(F.col("departure_port"), F.lit("->"), F.col("arrival_port"), F.lit(":"), F.col("p").cast("string")).alias("s")))),
        lambda x: x["s"]), "|").alias("digest"))
    # The preset table has one row per preset: a bounded, tiny equi-join.
    out = dp.join(digest, "ps", "left")
    return out.select(
        "ps.ord", "ps.preset", "ps.lookback_days", "ps.effective_days", "ps.start_date", "ps.end_date", "day_rows",
        F.concat(F.col("ps.end_date").cast("string"), F.lit("|rows:"), F.col("rows_total").cast("string"), F.lit("|pax:"),
                 F.col("passengers_total").cast("string"), F.lit("|top:"),
                 F.substring(F.sha2(F.coalesce(F.col("digest"), F.lit("none")), 256), 1, 16)).alias("data_version"),
    )
