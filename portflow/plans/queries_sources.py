"""Registered source/sink queries: ingest (SRC1–SRC5) and range readers (SRC8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from portflow.operators import quality as Q
from portflow.plans.models import TrafficModels
from portflow.plans.oracle_base import cte, js, with_ctes
from portflow.plans.registry import register
from portflow.sources import ingest as I
from portflow.sources import readers as RD
from portflow.sources.sinks import append_landing, through_storage
from portflow.sources.testdata import FIRST_LOAD_AT, REPEAT_LOAD_AT, record_tasks, star_records


def _landed(spark, sf_dir, odd=False, bad=False):
    path = I.scratch_path(spark, "landing")
    I.land_payloads(star_records(spark, sf_dir), path, odd=odd, bad=bad)
    return I.read_payloads(spark, path)


# What the awkward records hold, and the canonical text of every landed record.
cte(
    "landed", ("srcp",),
    f"""
    SELECT * REPLACE (
             CASE WHEN is_odd THEN 'Πειραιάς' ELSE departureportname END AS departureportname,
             CASE WHEN is_odd THEN CAST(passengercount AS VARCHAR) || '.0' ELSE CAST(passengercount AS VARCHAR) END AS passengercount,
             CASE WHEN is_odd THEN '100.0' ELSE CAST(vehiclecount AS VARCHAR) END AS vehiclecount,
             CASE WHEN is_odd THEN
               '{{"arrivalportname": ' || {js('arrivalportname')} || ', "date": ' || {js('date')} || ', "departureportname": "Πειραιάς", '
               || '"meta": {{"a": ["q", null, true], "z": 1.5}}, "passengercount": ' || CAST(passengercount AS VARCHAR) || '.0, "routecode": '
               || {js('routecode')} || ', "routecodenames": ' || {js('routecodenames')} || ', "vehiclecount": 100.0}}'
             ELSE payload END AS payload)
    FROM (SELECT *, l_orderkey % {I.ODD_EVERY} = {I.ODD_AT} AS is_odd FROM srcp)
    """,
)


@register(
    "ingest_extract_records",
    with_ctes("SELECT date, routecode, routecodenames, departureportname, arrivalportname, passengercount, vehiclecount FROM landed", "landed"),
)
def q_ingest_extract_records(spark, sf_dir):
    """SRC1: landed payloads (four shapes, stray non-object elements, wrong shapes) → source records."""
    recs, _bad = I.extract_records(_landed(spark, sf_dir, odd=True, bad=True))
    return I.records_as_fields(recs)


@register(
    "ingest_raw_rows",
    with_ctes(
        "SELECT sha256(payload) AS record_hash, date AS service_date, routecode AS route_code, routecodenames AS route_name, "
        "departureportname AS departure_port, arrivalportname AS arrival_port, passengercount AS passenger_count, "
        "vehiclecount AS vehicle_count, TIMESTAMP '2026-01-01 06:00:00' AS ingested_at, payload AS raw_payload FROM landed", "landed"),
)
def q_ingest_raw_rows(spark, sf_dir):
    """SRC2: records → raw rows with canonical-JSON hashes (decimal counts, a nested field and Greek text among them)."""
    recs, _bad = I.extract_records(_landed(spark, sf_dir, odd=True))
    return I.raw_rows(recs, FIRST_LOAD_AT)


@register(
    "ingest_quarantine",
    with_ctes(
        """SELECT reason, count(*) AS count FROM (
             SELECT list_extract(['not valid JSON', 'expected list or dict, got STRING', 'expected one of records/results/data keys',
                                  'wrapped value is not a list', 'wrapped value is not a list'], day(CAST(date AS DATE)) % 5 + 1) AS reason
             FROM (SELECT DISTINCT date FROM src)) GROUP BY reason""", "src"),
)
def q_ingest_quarantine(spark, sf_dir):
    """SRC1 error path: payloads of the wrong shape are quarantined with a reason."""
    _recs, bad = I.extract_records(_landed(spark, sf_dir, bad=True))
    return bad.select("reason").groupBy("reason").count()


@register(
    "dq_landed_casts",
    with_ctes("SELECT 'passenger_count' AS column_name, count(*) FILTER (is_odd) AS violations FROM landed "
              "UNION ALL SELECT 'vehicle_count', count(*) FILTER (is_odd) FROM landed", "landed"),
)
def q_dq_landed_casts(spark, sf_dir):
    """DQ6/DQ7 on landed rows: decimal counts that the safe cast drops are counted."""
    raw = I.raw_rows(I.extract_records(_landed(spark, sf_dir, odd=True))[0], FIRST_LOAD_AT)
    return Q.safe_casts_dropped(raw, {"passengercount": "passenger_count", "vehiclecount": "vehicle_count"})


@register(
    "raw_append_roundtrip",
    with_ctes("SELECT * FROM row_counts_daily", "row_counts_daily"),
)
def q_raw_append_roundtrip(spark, sf_dir):
    """SRC5: two appended loads (the second re-lands a share of records) → landing → staging → dedup → daily counts."""
    recs, _bad = I.extract_records(_landed(spark, sf_dir))
    landing = I.scratch_path(spark, "raw")
    append_landing(I.raw_rows(recs, FIRST_LOAD_AT), landing)
    star = star_records(spark, sf_dir).where(F.col("l_orderkey") % 7 == 0)
    again = star.select(F.to_json(F.struct(*[F.col(f) for f in I.SOURCE_FIELDS]), {"ignoreNullFields": "false"}).alias("record"))
    append_landing(I.raw_rows(again, REPEAT_LOAD_AT), landing)
    m = TrafficModels(spark, raw=spark.read.parquet(landing), hash_of_payload=True)
    return m.row_counts_daily


cte("rawb", ("raw",), "SELECT MIN(CAST(service_date AS DATE)) AS start_date, MAX(CAST(service_date AS DATE)) AS end_date FROM raw")
cte(
    "pwin_m",
    ("rawb",),
    """
    SELECT i AS window_index, ws AS window_start, least(CAST(next_ws - INTERVAL 1 DAY AS DATE), e) AS window_end FROM (
      WITH RECURSIVE w(i, ws, e) AS (
        SELECT 0, start_date - 1, end_date - 1 FROM rawb
        UNION ALL SELECT i + 1, CAST(ws + INTERVAL 8 MONTH AS DATE), e FROM w WHERE CAST(ws + INTERVAL 8 MONTH AS DATE) <= e)
      SELECT i, ws, e, CAST(ws + INTERVAL 8 MONTH AS DATE) AS next_ws FROM w)
    """,
)


def _day_counts(spark, sf_dir):
    """Landed rows per valid service date, stored: the one scan that bounds, windows and the audit are made from."""
    return through_storage(I.landed_days(TrafficModels(spark, sf_dir).raw), "landed-days")


def _bounds(spark, sf_dir):
    """First and last landed day; of the landing only the date is read."""
    return _span(I.landed_days(TrafficModels(spark, sf_dir).raw))


def _span(days):
    return days.agg(F.min("d").alias("start_date"), F.max("d").alias("end_date"))


@register("plan_windows", with_ctes("SELECT * FROM pwin_m", "pwin_m"))
def q_plan_windows(spark, sf_dir):
    """SRC3: 8-month chained windows over the landed date range, 1 day of source lag."""
    return I.plan_windows(_bounds(spark, sf_dir), "month", 8, 1)


@register(
    "plan_windows_day",
    with_ctes(
        "SELECT CAST(i AS INTEGER) AS window_index, ws AS window_start, least(ws + 29, end_date) AS window_end FROM ("
        "SELECT row_number() OVER (ORDER BY ws) - 1 AS i, ws, end_date FROM ("
        "SELECT CAST(unnest(generate_series(start_date, end_date, INTERVAL 30 DAY)) AS DATE) AS ws, end_date FROM rawb))", "rawb"),
)
def q_plan_windows_day(spark, sf_dir):
    """SRC3: 30-day windows, no lag."""
    return I.plan_windows(_bounds(spark, sf_dir), "day", 30, 0).select(
        F.col("window_index").cast("int").alias("window_index"), "window_start", "window_end")


@register(
    "audit_windows",
    with_ctes(
        """SELECT w.window_index, w.window_start, w.window_end, CAST(COALESCE(c.n, 0) AS BIGINT) AS rows_loaded,
                  CASE WHEN COALESCE(c.n, 0) = 0 THEN 'empty' ELSE 'loaded' END AS status,
                  COUNT(*) OVER () AS total_windows,
                  CAST(SUM(CASE WHEN COALESCE(c.n, 0) = 0 THEN 1 ELSE 0 END) OVER () AS BIGINT) AS empty_windows,
                  CAST(SUM(COALESCE(c.n, 0)) OVER () AS BIGINT) AS total_rows
           FROM pwin_m w LEFT JOIN (
             SELECT w2.window_index, COUNT(*) AS n FROM raw r JOIN pwin_m w2
               ON TRY_CAST(r.service_date AS DATE) BETWEEN w2.window_start AND w2.window_end GROUP BY 1) c
           ON c.window_index = w.window_index""",
        "pwin_m", "raw"),
)
def q_audit_windows(spark, sf_dir):
    """SRC4: rows landed per planned window, from one scan of the landing table."""
    days = _day_counts(spark, sf_dir)
    return I.audit_days(I.plan_windows(_span(days), "month", 8, 1), days)


@register(
    "load_audit",
    with_ctes(
        """SELECT w.window_index, w.window_start, w.window_end, CAST(count(r.service_date) AS BIGINT) AS rows_loaded,
                  CASE WHEN count(r.service_date) = 0 THEN 'empty' ELSE 'loaded' END AS status, COUNT(*) OVER () AS total_windows,
                  CAST(SUM(CASE WHEN count(r.service_date) = 0 THEN 1 ELSE 0 END) OVER () AS BIGINT) AS empty_windows,
                  CAST(SUM(count(r.service_date)) OVER () AS BIGINT) AS total_rows,
                  (SELECT COUNT(*) FROM raw) AS rows_written
           FROM pwin_m w LEFT JOIN raw r ON TRY_CAST(r.service_date AS DATE) BETWEEN w.window_start AND w.window_end GROUP BY ALL""",
        "pwin_m", "raw"),
)
def q_load_audit(spark, sf_dir):
    """SRC4 at load time: windows counted while the landing is written, nothing read again."""
    raw = TrafficModels(spark, sf_dir).raw
    windows = through_storage(I.plan_windows(_bounds(spark, sf_dir), "month", 8, 1), "windows")
    return I.land_and_audit(raw, I.scratch_path(spark, "landing"), windows)


def _reader_query(reader: str, cte_name: str, col: str, cols: str):
    def q(spark, sf_dir):
        m = TrafficModels(spark, sf_dir).materialize()
        table = {"daily": m.row_counts_daily, "weekly": m.row_counts_weekly, "monthly": m.row_counts_monthly,
                 "routes": m.fct_route_daily, "ports": m.fct_port_daily}[reader]
        first, last = (m.row_counts_daily.agg(f("service_date")).scalar() for f in (F.min, F.max))
        return RD.range_read(spark, table, reader, first, last)

    sql = with_ctes(
        f"SELECT {cols} FROM {cte_name} WHERE {col} BETWEEN (SELECT MIN(service_date) FROM row_counts_daily) "
        f"AND (SELECT MAX(service_date) FROM row_counts_daily) ORDER BY {col}",
        cte_name, "row_counts_daily")
    register(f"load_{reader}", sql)(q)


for _r, _c in (("daily", "row_counts_daily"), ("weekly", "row_counts_weekly"), ("monthly", "row_counts_monthly"),
               ("routes", "fct_route_daily"), ("ports", "fct_port_daily")):
    _reader_query(_r, _c, RD.READERS[_r][1], RD.READERS[_r][2])


# ---- stored tables: layouts, state, buckets ------------------------------------------------------------

from portflow.operators import rollups as U  # noqa: E402
from portflow.plans.models import TABLE_ATTRS  # noqa: E402
from portflow.sources.catalogue import LAYOUTS, TOKEN_TABLES, Catalogue, bucketed  # noqa: E402

BUCKETS = 64
_CTE_OF = {
    "raw_sailing_traffic": "raw", "stg_sailing_traffic": "stg", "int_traffic_record": "rec", "int_route_day": "route_day",
    "int_port_movement": "port_movement", "int_port_day": "port_day",
    **{f"fct_route_traffic_{g}": f"fct_route_{g}" for g in ("daily", "weekly", "monthly")},
    **{f"fct_port_activity_{g}": f"fct_port_{g}" for g in ("daily", "weekly", "monthly")},
}


# Tables made of the stored route-day grain.
_STORABLE = [t for t in TABLE_ATTRS if t not in ("raw_sailing_traffic", "stg_sailing_traffic", "int_traffic_record", "int_port_movement", "dim_route", "dim_route_pair")]


def _layout_sql() -> str:
    parts = []
    for t in _STORABLE:
        grain = LAYOUTS[t].grain
        day = f"TRY_CAST({grain} AS DATE)" if grain else "CAST(NULL AS DATE)"
        parts.append(f"SELECT '{t}' AS table_name, COUNT(*) AS rows_count, CAST(MIN({day}) AS DATE) AS first_day, CAST(MAX({day}) AS DATE) AS last_day, "
                     f"COUNT(DISTINCT date_trunc('{LAYOUTS[t].unit}', {day})) AS periods FROM {_CTE_OF.get(t, t)}")
    return with_ctes(" UNION ALL ".join(parts), *[_CTE_OF.get(t, t) for t in _STORABLE])


@register("stored_layouts", _layout_sql())
def q_stored_layouts(spark, sf_dir):
    """SRC6: every table that derives from route-day stored in its layout; rows, days and directories as they lie there."""
    m = TrafficModels(spark, sf_dir).materialize()
    cat, out = Catalogue(spark), None
    tasks = record_tasks(spark, sf_dir)
    # the large tables: the days lie by month in storage, weeks and months are dealt by year as they are summed
    dealt = {t: getattr(m, TABLE_ATTRS[t]) for t in ("int_route_day", "fct_route_traffic_daily")} | {
        f"fct_route_traffic_{g}ly": U.route_period_of_days(m.route_day, g, "year", tasks) for g in ("week", "month")}
    for t in _STORABLE:
        cat.write(t, dealt[t] if t in dealt else getattr(m, TABLE_ATTRS[t]), dealt=t in dealt)
        grain = LAYOUTS[t].grain
        rows = spark.read.parquet(cat.path(t))
        day = F.col(grain).try_cast("date") if grain else F.lit(None).cast("date")
        one = rows.agg(F.lit(t).alias("table_name"), F.count("*").alias("rows_count"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
                       F.countDistinct(F.col("period") if grain else F.lit(None)).alias("periods"))
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "refresh_token_stored",
    with_ctes(
        "SELECT 'row_counts_daily' AS table_name, (SELECT COUNT(*) FROM row_counts_daily) AS rows_count, TRUE AS in_token, TRUE AS changed_by_rewrite "
        "UNION ALL SELECT 'fct_route_traffic_daily', (SELECT COUNT(*) FROM fct_route_daily), TRUE, FALSE "
        "UNION ALL SELECT 'fct_port_activity_daily', (SELECT COUNT(*) FROM fct_port_daily), TRUE, FALSE "
        "UNION ALL SELECT 'intelligence_snapshots', CAST(3 AS BIGINT), TRUE, FALSE", "row_counts_daily", "fct_route_daily", "fct_port_daily"),
)
def q_refresh_token_stored(spark, sf_dir):
    """ANA5 from stored tables: the token names every table, and only the one that is written again changes in it."""
    from portflow.operators import snapshots as S

    m = TrafficModels(spark, sf_dir).materialize()
    cat = Catalogue(spark)
    tables = {"row_counts_daily": m.row_counts_daily, "fct_route_traffic_daily": m.fct_route_daily, "fct_port_activity_daily": m.fct_port_daily,
              "intelligence_snapshots": S.intelligence_snapshots(m.daily, m.route_day, m.fct_port_daily, month_col="service_month_start")}
    for t in TOKEN_TABLES:
        cat.write(t, tables[t])
    before = through_storage(cat.state().withColumn("data_token", cat.token().scalar()), "state-before")
    cat.write("row_counts_daily", tables["row_counts_daily"])
    after = cat.state().select("table_name", F.col("last_modified").alias("later"))
    return before.join(after, "table_name").select(
        "table_name", "rows_count", F.contains(F.col("data_token"), F.concat("table_name", F.lit(":"))).alias("in_token"),
        (F.col("later") != F.col("last_modified")).alias("changed_by_rewrite"))


def _from_buckets(grain: str):
    def q(spark, sf_dir):
        daily = bucketed(TrafficModels(spark, sf_dir).materialize().fct_route_daily, BUCKETS)
        return {"weekly": U.fct_route_weekly, "monthly": U.fct_route_monthly}[grain](daily)

    q.__doc__ = f"SRC6: the {grain} route fact from the bucketed daily one, without a shuffle."
    register(f"route_{grain}_from_buckets", with_ctes(f"SELECT * FROM fct_route_{grain}", f"fct_route_{grain}"))(q)


_from_buckets("weekly")
_from_buckets("monthly")
