"""Registered data-quality queries: one per table, the custom checks, and all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from portflow.operators import quality as Q
from portflow.plans.models import TABLE_ATTRS, TrafficModels
from portflow.plans.oracle_base import sdate, sint, with_ctes
from portflow.plans.registry import register
from portflow.sources.sinks import through_storage

# Oracle CTE name per warehouse table.
_CTE = {
    "raw_sailing_traffic": "raw",
    "stg_sailing_traffic": "stg",
    "int_traffic_record": "rec",
    "int_route_day": "route_day",
    "int_port_movement": "port_movement",
    "int_port_day": "port_day",
    "fct_route_traffic_daily": "fct_route_daily",
    "fct_route_traffic_weekly": "fct_route_weekly",
    "fct_route_traffic_monthly": "fct_route_monthly",
    "fct_port_activity_daily": "fct_port_daily",
    "fct_port_activity_weekly": "fct_port_weekly",
    "fct_port_activity_monthly": "fct_port_monthly",
}


def _sql_check(table: str, column: str, check: str) -> str:
    src = _CTE.get(table, table)
    if check == "unique":
        v = (f"(SELECT COALESCE(SUM(n - 1), 0) FROM (SELECT COUNT(*) AS n FROM {src} "
             f"WHERE {column} IS NOT NULL GROUP BY {column} HAVING COUNT(*) > 1))")
    else:
        cond = {
            "not_null": f"{column} IS NULL",
            "positive": f"{column} <= 0",
            "non_negative": f"{column} < 0",
            "accepted_values": f"{column} NOT IN ('departure', 'arrival')",
        }[check]
        v = f"(SELECT COUNT(*) FILTER (WHERE {cond}) FROM {src})"
    return (f"SELECT '{table}' AS table_name, '{column}' AS column_name, '{check}' AS check_name, "
            f"CAST({v} AS BIGINT) AS violations")


def _sql_table(table: str) -> str:
    return " UNION ALL ".join(_sql_check(table, c, k) for c, k in Q.CHECKS[table])


def _wrap(body: str, *ctes: str) -> str:
    return with_ctes(f"SELECT *, violations = 0 AS passed FROM ({body})", *ctes)


def dq_table(m: TrafficModels, table: str) -> DataFrame:
    return Q.run_checks(table, getattr(m, TABLE_ATTRS[table]))


# Tables made of records, below the stored route-day grain.
_BELOW_DAYS = ("raw_sailing_traffic", "stg_sailing_traffic", "int_traffic_record", "int_port_movement", "dim_route", "dim_route_pair")

for _t in Q.CHECKS:

    def _q(spark, sf_dir, _t=_t):
        m = TrafficModels(spark, sf_dir)
        return dq_table(m if _t in _BELOW_DAYS else m.materialize(), _t)

    register(f"dq_{_t}", _wrap(_sql_table(_t), _CTE.get(_t, _t)))(_q)


def _custom_sql() -> str:
    def dropped(field: str) -> str:
        v = f"json_extract_string(raw_payload, '$.{field}')"
        d = sdate("json_extract_string(raw_payload, '$.date')")
        return (f"(SELECT COUNT(*) FROM raw WHERE {d} IS NOT NULL "
                f"AND NULLIF(trim({v}), '') IS NOT NULL AND {sint(v)} IS NULL)")

    nat_route = ("COALESCE(route_code, route_name, 'unknown_itinerary|' || COALESCE(departure_port, 'unknown_departure') "
                 "|| '|' || COALESCE(arrival_port, 'unknown_arrival'))")
    nat_pair = "COALESCE(route_code, route_name, '') || '|' || COALESCE(departure_port, '') || '|' || COALESCE(arrival_port, '')"

    def coll(key: str, nat: str) -> str:
        return f"(SELECT COUNT(*) FROM (SELECT {key} FROM rec GROUP BY {key} HAVING COUNT(DISTINCT {nat}) > 1))"

    rows = [
        ("stg_sailing_traffic", "passenger_count", "passenger_count_safe_cast_did_not_drop_values", dropped("passengercount")),
        ("stg_sailing_traffic", "vehicle_count", "vehicle_count_safe_cast_did_not_drop_values", dropped("vehiclecount")),
        ("int_traffic_record", "route_key", "route_key_has_no_hash_collisions", coll("route_key", nat_route)),
        ("int_traffic_record", "route_pair_key", "route_pair_key_has_no_hash_collisions", coll("route_pair_key", nat_pair)),
        ("int_traffic_record", "route_pair_key", "route_pair_key_maps_to_single_route_key", coll("route_pair_key", "route_key")),
    ]
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{k}' AS check_name, CAST({v} AS BIGINT) AS violations"
        for t, c, k, v in rows
    )


@register("dq_custom", _wrap(_custom_sql(), "raw", "rec"))
def q_dq_custom(spark, sf_dir):
    m = TrafficModels(spark, sf_dir)
    return Q.custom_checks(m.raw, m.records)


@register(
    "dq_summary",
    _wrap(" UNION ALL ".join([_sql_table(t) for t in Q.CHECKS] + [_custom_sql()]), *sorted(set(_CTE.values())),
          "dim_port", "dim_route", "dim_route_pair", "row_counts_daily", "row_counts_weekly", "row_counts_monthly",
          "row_counts_yearly"),
)
def q_dq_summary(spark, sf_dir):
    """Every declared and custom check over the whole chain, one result table.

    Twenty tables are checked: the records and day-grain facts are stored
    once, and each table's checks read storage instead of the star join. No
    check reads the records' payloads. One table's results are stored before
    the next one's are made, so that the shuffles of two never lie on disk
    together.
    """
    m = TrafficModels(spark, sf_dir).materialize(records=True, payload=False)
    landing = ("raw_sailing_traffic", "stg_sailing_traffic")
    parts = [("landing", Q.landing_checks(m.raw)), *((t, dq_table(m, t)) for t in Q.CHECKS if t not in landing), ("collisions", Q.collision_checks(m.records))]
    return reduce(DataFrame.unionByName, [through_storage(df, f"checks-of-{name}") for name, df in parts])
