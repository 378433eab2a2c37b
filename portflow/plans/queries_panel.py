"""Registered panel-layer queries (PAN-A … PAN-V).

The panel runs over the full available range (the ``full`` preset) with a
7-day KPI window; the snapshot table for lookups is the model's
deepen-chart rows plus the auto-panel row built from the same data.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portflow.operators import panel as P
from portflow.operators import snapshots as S
from portflow.plans.models import TrafficModels
from portflow.plans.registry import register


def _frames(spark, sf_dir):
    # The panel reads the day-grain facts many times (scope, KPIs, leaders):
    # store them once, then every subquery reads the small tables.
    m = TrafficModels(spark, sf_dir).materialize()
    return m, m.daily, m.routes_by_month, m.ports


def _ctx(spark, sf_dir):
    m, d, r, p = _frames(spark, sf_dir)
    return P.panel_context(d, r, p, 7)


@register("notable_change")
def q_notable_change(spark, sf_dir):
    _, d, r, _ = _frames(spark, sf_dir)
    return P.notable_change(d, r)


@register("prepare_scoped")
def q_prepare_scoped(spark, sf_dir):
    return P.prepare_routes(_frames(spark, sf_dir)[2])


def _as_text(df: DataFrame, numbers: list[str]) -> DataFrame:
    """A frame as text, with a bad date on every 13th day of a month and a bad number on every 7th."""
    day = F.dayofmonth("service_date")
    return df.select(
        F.when(day == 13, F.lit("13/xx")).otherwise(F.concat(F.lit(" "), F.col("service_date").cast("string"))).alias("service_date"),
        *[F.when(day == 7, F.lit("n/a")).otherwise(F.concat(F.col(c).cast("string"), F.lit(".0 "))).alias(c) for c in numbers],
        *[c for c in df.columns if c not in (*numbers, "service_date")],
    )


@register("prepare_daily")
def q_prepare_daily(spark, sf_dir):
    """PAN-B on text: bad dates drop, bad numbers are 0, an absent column is 0."""
    return P.prepare_daily(_as_text(_frames(spark, sf_dir)[1], ["rows_count", "total_passengers"]).drop("total_vehicles"))


@register("prepare_ports")
def q_prepare_ports(spark, sf_dir):
    """PAN-B on text: departing and arriving passengers added, each 0 where bad."""
    return P.prepare_ports(_as_text(_frames(spark, sf_dir)[3], ["total_departing_passengers"]))


@register("panel_scope")
def q_panel_scope(spark, sf_dir):
    return P.panel_scope(_frames(spark, sf_dir)[1], 7)


@register("panel_kpis")
def q_panel_kpis(spark, sf_dir):
    _, d, r, _ = _frames(spark, sf_dir)
    return P.panel_kpis(d, r, 7)


@register("panel_top_corridors")
def q_panel_top_corridors(spark, sf_dir):
    _, d, r, _ = _frames(spark, sf_dir)
    return P.panel_top_corridors(d, r, 7)


@register("panel_top_ports")
def q_panel_top_ports(spark, sf_dir):
    _, d, _, p = _frames(spark, sf_dir)
    return P.panel_top_ports(d, p, 7)


@register("panel_prev_top")
def q_panel_prev_top(spark, sf_dir):
    _, d, r, _ = _frames(spark, sf_dir)
    return P.panel_prev_top(d, r)


@register("panel_deltas")
def q_panel_deltas(spark, sf_dir):
    return P.panel_deltas(_ctx(spark, sf_dir))


@register("panel_signals")
def q_panel_signals(spark, sf_dir):
    return P.panel_signals(_ctx(spark, sf_dir))


@register("panel_actions")
def q_panel_actions(spark, sf_dir):
    return P.panel_actions(_ctx(spark, sf_dir))


@register("panel_source_json")
def q_panel_source_json(spark, sf_dir):
    return P.panel_source_json(_ctx(spark, sf_dir))


@register("panel_report")
def q_panel_report(spark, sf_dir):
    return P.panel_report(_ctx(spark, sf_dir))


@register("py_data_version")
def q_py_data_version(spark, sf_dir):
    _, d, r, _ = _frames(spark, sf_dir)
    return P.py_data_version(d, r)


def _attach_oracles():
    from portflow.plans import oracle_panel as O
    from portflow.plans.oracle_base import with_ctes
    from portflow.plans.registry import ORACLE

    ORACLE.update({
        "notable_change": O.NOTABLE_SQL,
        "prepare_scoped": with_ctes("SELECT * FROM pr_", "pr_"),
        "prepare_daily": with_ctes(
            "SELECT service_date, CASE WHEN day(service_date) = 7 THEN 0 ELSE rows_count END AS rows_count, "
            "CASE WHEN day(service_date) = 7 THEN 0 ELSE total_passengers END AS total_passengers, CAST(0 AS BIGINT) AS total_vehicles "
            "FROM row_counts_daily WHERE day(service_date) <> 13", "row_counts_daily"),
        "prepare_ports": with_ctes(
            "SELECT service_date, port_name, total_arriving_passengers + CASE WHEN day(service_date) = 7 THEN 0 ELSE total_departing_passengers END "
            "AS total_passengers FROM port_day WHERE day(service_date) <> 13", "port_day"),
        "panel_scope": O.SCOPE_SQL,
        "panel_kpis": O.KPIS_SQL,
        "panel_top_corridors": with_ctes("SELECT * FROM ptc", "ptc"),
        "panel_top_ports": with_ctes("SELECT * FROM ptp", "ptp"),
        "panel_prev_top": with_ctes("SELECT * FROM pprev", "pprev"),
        "panel_deltas": with_ctes("SELECT * FROM pdelta", "pdelta"),
        "panel_signals": with_ctes("SELECT * FROM psig", "psig"),
        "panel_actions": with_ctes("SELECT * FROM pact", "pact"),
        "py_data_version": O.PY_VERSION_SQL,
    })


_attach_oracles()


# ---- snapshot table, live report, presets, lookups ---------------------------------------------------

import datetime as _dt  # noqa: E402

from portflow.operators import analytics as N  # noqa: E402
from portflow.sources.sinks import scratch_path, snapshot_upsert, through_storage  # noqa: E402
from portflow.sources.snapshot_store import SnapshotStore  # noqa: E402

PANEL_TS = _dt.datetime(2026, 1, 3, 0, 5, 0)


def _panel_row(m, kpi_window_days: int = 7, ts=PANEL_TS):
    d, r, p = m.daily, m.routes_by_month, m.ports
    return P.panel_snapshot_row(P.panel_context(d, r, p, kpi_window_days), F.lit(ts).cast("timestamp_ntz"))


def snapshot_table_of(m) -> DataFrame:
    """Deepen-chart rows of the SQL model + the auto-panel row, as the snapshot table holds them."""
    deepen = S.intelligence_snapshots(m.daily, m.route_day, m.fct_port_daily, month_col="service_month_start")
    return deepen.unionByName(_panel_row(m))


_SNAP_OUT = ["snapshot_ts", "chart_id", "insight_type", "data_version", "filter_hash", "title", "summary", "facts",
             "anomalies", "comparisons", "recommendations", "report_text", "insight_text", "generation_mode"]


@register("panel_snapshot")
def q_panel_snapshot(spark, sf_dir):
    """PAN-L: the auto-panel row of the snapshot table."""
    m = _frames(spark, sf_dir)[0]
    return _panel_row(m).select(*_SNAP_OUT)


WRITER_END = "2000-06-30"


@register("panel_writer")
def q_panel_writer(spark, sf_dir):
    """PAN-U: the rows that the scheduled writer stores for two lookbacks and an end date before the newest day."""
    m = _frames(spark, sf_dir)[0]
    rows = P.panel_rows(m.daily, m.routes_by_month, m.ports, ["90", "30"], WRITER_END, snapshot_ts=F.lit(PANEL_TS).cast("timestamp_ntz"))
    return rows.select(*_SNAP_OUT)


@register("live_report")
def q_live_report(spark, sf_dir):
    m = _frames(spark, sf_dir)[0]
    return P.live_report(m.daily, m.routes, m.ports, N.full_view(m.daily))


@register("filter_hash")
def q_filter_hash(spark, sf_dir):
    """PAN-P: the filter hash of every corridor filter the dashboard offers."""
    m = _frames(spark, sf_dir)[0]
    b = N.bounds(m.daily)
    opts = N.corridor_options(m.routes)
    filters = P.sorted_struct(
        route=F.col("corridor"), port=F.lit("All ports"), grain=F.lit("weekly"), top_n=F.lit(10),
        start=b.getField("mn").cast("string"), end=b.getField("mx").cast("string"))
    return opts.select("corridor", filters.alias("f")).select("corridor", P.filter_hash(F.col("f")).alias("filter_hash"))


@register("panel_presets")
def q_panel_presets(spark, sf_dir):
    m = _frames(spark, sf_dir)[0]
    return P.panel_presets(m.daily, m.routes, ["full", "year", "90", "30", "7"])


def _snapshots(spark, sf_dir):
    return snapshot_table_of(_frames(spark, sf_dir)[0])


@register("snapshot_lookup")
def q_snapshot_lookup(spark, sf_dir):
    """PAN-Q: the panel row for the current data version (exact hash first, then a NULL-hash row)."""
    m = _frames(spark, sf_dir)[0]
    snaps = snapshot_table_of(m)
    version = P.py_data_version(m.daily, m.routes).scalar()
    return P.snapshot_lookup(snaps, F.lit("agent_panel"), version, F.lit("0000000000000000"), F.lit("auto_panel")).select(*_SNAP_OUT)


@register("snapshot_latest")
def q_snapshot_latest(spark, sf_dir):
    """PAN-R: newest row per chart, ignoring the version."""
    snaps = _snapshots(spark, sf_dir)
    parts = [P.snapshot_latest(snaps, F.lit(c)) for c in ("agent_panel", "traffic_pulse", "top_corridors", "port_balance")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*_SNAP_OUT)


@register("snapshot_freshness")
def q_snapshot_freshness(spark, sf_dir):
    """PAN-S at three probe times: 1 h, exactly 48 h and 48.1 h after the newest panel row."""
    snaps = _snapshots(spark, sf_dir)
    out = None
    for label, hours in (("1h", 1.0), ("48h", 48.0), ("48.1h", 48.1)):
        now = F.lit(PANEL_TS + _dt.timedelta(hours=hours)).cast("timestamp_ntz")
        f = P.snapshot_freshness(snaps, now).select(F.lit(label).alias("probe"), "*")
        out = f if out is None else out.unionByName(f)
    return out


@register("snapshot_lines")
def q_snapshot_lines(spark, sf_dir):
    return P.snapshot_lines(_snapshots(spark, sf_dir))


@register("panel_cache_match")
def q_panel_cache_match(spark, sf_dir):
    """PAN-V on the dashboard page (default scope): KPI dates of the stored panel vs the current 7 days."""
    m = _frames(spark, sf_dir)[0]
    lines = P.snapshot_lines(snapshot_table_of(m)).where(F.col("chart_id") == "agent_panel")
    view = N.default_view(m.daily)
    cur_end = view.apply(m.daily).agg(F.max("service_date")).scalar()
    return P.panel_cache_match(lines, F.date_sub(cur_end, 6), cur_end, F.lit(True))


@register("snapshot_upsert")
def q_snapshot_upsert(spark, sf_dir):
    """SRC7: re-running the writers later (same keys, one with filter_hash '') plus a 14-day-window panel row."""
    m = _frames(spark, sf_dir)[0]
    target = snapshot_table_of(m)
    later = F.lit(PANEL_TS + _dt.timedelta(days=1)).cast("timestamp_ntz")
    rerun = target.withColumn("snapshot_ts", later).withColumn(
        "filter_hash", F.when(F.col("chart_id") == "agent_panel", F.lit("")).otherwise(F.col("filter_hash")))
    wider = _panel_row(m, 14, PANEL_TS + _dt.timedelta(days=2)).withColumn("data_version", F.concat(F.col("data_version"), F.lit("|kpi14")))
    merged = snapshot_upsert(target, rerun.unionByName(wider))
    return merged.select("snapshot_ts", "chart_id", "insight_type", "data_version", "filter_hash", "title", "generation_mode")


@register("upsert_then_lookup")
def q_upsert_then_lookup(spark, sf_dir):
    """SRC7 twice, then PAN-Q: stored rows re-written with hash '' keep their NULL hash and are found again under their version."""
    m = _frames(spark, sf_dir)[0]
    target = through_storage(snapshot_table_of(m), "snapshot-rows")
    store = SnapshotStore.create(target, scratch_path(spark, "snapshot-store"))
    for days in (1, 2):
        later = F.lit(PANEL_TS + _dt.timedelta(days=days)).cast("timestamp_ntz")
        store.upsert(target.withColumn("snapshot_ts", later).withColumn("filter_hash", F.lit("")))
    version = P.py_data_version(m.daily, m.routes).scalar()
    found = P.snapshot_lookup(store.read(), F.lit("agent_panel"), version, F.lit("0000000000000000"), F.lit("auto_panel"))
    return found.select("snapshot_ts", "chart_id", "insight_type", "data_version", "filter_hash", "title", "summary")


@register("upsert_touched_buckets")
def q_upsert_touched_buckets(spark, sf_dir):
    """SRC7 on a table with a row a corridor and day-of-year version: an upsert of one corridor's rows leaves all other buckets' files alone."""
    m = _frames(spark, sf_dir)[0]
    rows = m.routes_by_month.groupBy("departure_port", "arrival_port", "service_month_start").agg(F.sum("total_passengers").alias("p"))
    rows = rows.select(
        F.concat("departure_port", F.lit(" -> "), "arrival_port").alias("chart_id"), F.lit("corridor_month").alias("insight_type"),
        F.col("service_month_start").cast("string").alias("data_version"), F.lit(None).cast("string").alias("filter_hash"),
        F.lit(PANEL_TS).cast("timestamp_ntz").alias("snapshot_ts"), F.col("p").cast("string").alias("title"))
    rows = through_storage(rows, "corridor-months")
    store = SnapshotStore.create(rows, scratch_path(spark, "snapshot-store"), 64)
    file = F.col("_metadata.file_path")
    before = through_storage(store.stored().select("bucket", file.alias("file")).distinct(), "files-before")
    one = rows.agg(F.min(F.struct("chart_id", "data_version")).alias("k")).scalar()
    change = rows.where((F.col("chart_id") == one.getField("chart_id")) & (F.col("data_version") == one.getField("data_version")))
    rewritten = store.upsert(change.withColumn("title", F.lit("changed")))
    after = store.stored().select("bucket", file.alias("file")).distinct()
    kept = before.join(after, ["bucket", "file"], "left_semi").where(~F.col("bucket").isin(rewritten)).count()
    untouched = before.where(~F.col("bucket").isin(rewritten)).count()
    return store.read().agg(
        F.count("*").alias("rows_count"), F.count(F.when(F.col("title") == "changed", 1)).alias("changed_rows"),
        F.lit(len(rewritten)).alias("rewritten_buckets"), F.lit(kept == untouched).alias("other_files_kept"))


@register("snapshot_answers")
def q_snapshot_answers(spark, sf_dir):
    """PAN-Q/R as one lookup of several requests: a hash that is there, one that isn't, a stale and an unknown version, an unknown chart."""
    m = _frames(spark, sf_dir)[0]
    snaps = through_storage(snapshot_table_of(m), "snapshot-rows")
    panel = snaps.where(F.col("chart_id") == "agent_panel")
    filtered = panel.withColumn("filter_hash", F.lit("00000000000000aa")).withColumn("title", F.lit("filtered"))
    newer = F.lit(PANEL_TS + _dt.timedelta(days=3)).cast("timestamp_ntz")
    other = panel.withColumn("data_version", F.lit("older data")).withColumn("snapshot_ts", newer).withColumn("title", F.lit("written later"))
    snaps = snaps.unionByName(filtered).unionByName(other)
    version = P.py_data_version(m.daily, m.routes).scalar()
    ask = lambda i, chart, kind, v, h: F.struct(
        F.lit(i).alias("request_id"), F.lit(chart).alias("chart_id"), F.lit(kind).cast("string").alias("insight_type"), v.alias("data_version"), F.lit(h).cast("string").alias("filter_hash"))
    asked = F.array(
        ask(1, "agent_panel", "auto_panel", version, "00000000000000aa"), ask(2, "agent_panel", "auto_panel", version, "00000000000000bb"),
        ask(3, "agent_panel", None, version, None), ask(4, "agent_panel", "auto_panel", F.lit("older data"), "00000000000000aa"),
        ask(5, "agent_panel", "auto_panel", F.lit("no such data"), "00000000000000aa"), ask(6, "traffic_pulse", None, F.lit("no such data"), ""),
        ask(7, "no_such_chart", "auto_panel", version, "00000000000000aa"), ask(8, "agent_panel", "deepen_chart", version, "00000000000000aa"))
    requests = m.daily.agg(F.count("*")).select(asked.alias("a")).select(F.inline("a"))
    return P.snapshot_answers(snaps, requests).select("request_id", "match", "chart_id", "insight_type", "data_version", "filter_hash", "snapshot_ts", "title")


@register("panel_source_fields")
def q_panel_source_fields(spark, sf_dir):
    """PAN-K read back: the stored source document's parts, a row a field or list entry."""
    doc = P.panel_source_json(_ctx(spark, sf_dir))
    kpis = "passengers vehicles traffic_rows active_corridors congestion_index_pct recent_7d_avg_passengers prior_7d_avg_passengers recent_30d_avg_passengers prior_30d_avg_passengers"
    scope = "baseline_start baseline_end kpi_start kpi_end baseline_label kpi_label scope_label"
    strings = lambda names: ", ".join(f"{n}: string" for n in names.split())
    schema = (
        f"schema_version string, scope struct<{strings(scope)}>, kpis struct<{', '.join(f'{n}: double' for n in kpis.split())}>, "
        "top_corridors array<struct<pair_label: string, passengers: long, vehicles: long, share_pct: double>>, "
        f"top_ports array<struct<port_name: string, passengers: long>>, deltas array<struct<{strings('name label period direction severity summary')}, value_pct: double>>, "
        f"signals array<struct<{strings('kind severity summary')}>>, action_candidates array<struct<{strings('action rationale priority')}>>, "
        "previous_top_corridor_label string, notable_change_reasons array<string>")
    d = doc.select(F.from_json("source_snapshot_json", schema).alias("d")).select("d.*")

    def row(part: str, n, text, number=F.lit(None)):
        return F.struct(F.lit(part).alias("part"), n.cast("int").alias("ord"), text.cast("string").alias("text"), number.cast("double").alias("number"))

    def entries(column: str, text, number):
        return F.transform(column, lambda x, i: row(column, i + 1, text(x), number(x)))

    none = lambda x: F.lit(None)
    parts = F.concat(
        F.array(row("schema_version", F.lit(1), F.col("schema_version")), row("previous_top_corridor_label", F.lit(1), F.col("previous_top_corridor_label"))),
        F.array(*[row(f"scope.{n}", F.lit(1), F.col(f"scope.{n}")) for n in scope.split()]),
        F.array(*[row(f"kpis.{n}", F.lit(1), F.lit(None), F.col(f"kpis.{n}")) for n in kpis.split()]),
        entries("top_corridors", lambda x: F.concat(x["pair_label"], F.lit("|"), x["passengers"].cast("string"), F.lit("|"), x["vehicles"].cast("string")), lambda x: x["share_pct"]),
        entries("top_ports", lambda x: x["port_name"], lambda x: x["passengers"]),
        entries("deltas", lambda x: F.concat_ws("|", *[x[c] for c in "name label period direction severity summary".split()]), lambda x: x["value_pct"]),
        entries("signals", lambda x: F.concat_ws("|", *[x[c] for c in "kind severity summary".split()]), none),
        entries("action_candidates", lambda x: F.concat_ws("|", *[x[c] for c in "action rationale priority".split()]), none),
        entries("notable_change_reasons", lambda x: x, none),
    )
    return d.select(F.inline(parts))


def _attach_more_oracles():
    from portflow.plans import oracle_panel as O
    from portflow.plans.registry import ORACLE

    ORACLE.update({
        "panel_snapshot": O.PANEL_SNAPSHOT_SQL,
        "panel_writer": O.writer_sql(WRITER_END, [90, 30]),
        "panel_report": O.with_ctes(
            "SELECT title, summary, facts, anomalies, comparisons, recommendations, report_text, insight_text FROM preport", "preport"),
        "snapshot_lookup": O.LOOKUP_SQL,
        "snapshot_latest": O.LATEST_SQL,
        "snapshot_freshness": O.FRESHNESS_SQL,
        "snapshot_lines": O.LINES_SQL,
        "panel_cache_match": O.CACHE_SQL,
        "panel_presets": O.PRESETS_SQL,
        "filter_hash": O.FILTER_HASH_SQL,
        "snapshot_upsert": O.UPSERT_SQL,
        "upsert_then_lookup": O.UPSERT_LOOKUP_SQL,
        "upsert_touched_buckets": O.TOUCHED_SQL,
        "snapshot_answers": O.ANSWERS_SQL,
        "panel_source_fields": O.SOURCE_FIELDS_SQL,
        "live_report": O.LIVE_SQL,
    })


_attach_more_oracles()
