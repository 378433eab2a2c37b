"""Registered queries for the model chain (staging → records → rollups)."""

from __future__ import annotations


from portflow.plans.models import TrafficModels
from portflow.plans.oracle_base import with_ctes
from portflow.plans.registry import register

REC_COLS = (
    "event_id, source_record_id, service_date, service_week_start, service_month_start, service_year, "
    "service_month, service_season, route_key, route_pair_key, route_code, route_name, departure_port, "
    "arrival_port, passenger_count, vehicle_count, ingested_at"
)


def _m(spark, sf_dir) -> TrafficModels:
    return TrafficModels(spark, sf_dir)


def _stored(spark, sf_dir) -> TrafficModels:
    """Marts derive from the route-day grain: they read the one that the session has stored."""
    return TrafficModels(spark, sf_dir).materialize()


@register("stg_clean", with_ctes("SELECT * EXCLUDE (raw_payload) FROM stg", "stg"))
def q_stg_clean(spark, sf_dir):
    return _m(spark, sf_dir).stg.drop("raw_payload")


@register("int_traffic_record", with_ctes(f"SELECT {REC_COLS} FROM rec", "rec"))
def q_int_traffic_record(spark, sf_dir):
    return _m(spark, sf_dir).records.drop("raw_payload")


for _g in ("daily", "weekly", "monthly", "yearly"):

    def _rc(spark, sf_dir, _g=_g):
        return getattr(_stored(spark, sf_dir), f"row_counts_{_g}")

    register(f"row_counts_{_g}", with_ctes(f"SELECT * FROM row_counts_{_g}", f"row_counts_{_g}"))(_rc)


@register(
    "dedup_latest",
    with_ctes("SELECT record_hash, ingested_at, service_date, passenger_count, vehicle_count FROM dedup", "dedup"),
)
def q_dedup_latest(spark, sf_dir):
    from portflow.operators.records import dedup_latest

    return dedup_latest(_m(spark, sf_dir).stg).select(
        "record_hash", "ingested_at", "service_date", "passenger_count", "vehicle_count"
    )


@register(
    "record_keys",
    with_ctes("SELECT event_id, route_key, route_pair_key, route_code, route_name, departure_port, arrival_port FROM rec", "rec"),
)
def q_record_keys(spark, sf_dir):
    return _m(spark, sf_dir).records.select(
        "event_id", "route_key", "route_pair_key", "route_code", "route_name", "departure_port", "arrival_port"
    )


@register(
    "record_calendar",
    with_ctes(
        "SELECT event_id, service_date, service_week_start, service_month_start, service_year, service_month, service_season FROM rec",
        "rec",
    ),
)
def q_record_calendar(spark, sf_dir):
    return _m(spark, sf_dir).records.select(
        "event_id", "service_date", "service_week_start", "service_month_start", "service_year", "service_month",
        "service_season",
    )


_MODEL_KEYS = {
    "int_port_day": "port_day",
    "dim_port": "dim_port",
    "fct_route_daily": "fct_route_daily",
    "fct_route_weekly": "fct_route_weekly",
    "fct_route_monthly": "fct_route_monthly",
    "fct_port_daily": "fct_port_daily",
    "fct_port_weekly": "fct_port_weekly",
    "fct_port_monthly": "fct_port_monthly",
}
for _key, _attr in _MODEL_KEYS.items():

    def _model(spark, sf_dir, _attr=_attr):
        return getattr(_stored(spark, sf_dir), _attr)

    register(_key, with_ctes(f"SELECT * FROM {_attr}", _attr))(_model)


# made from records, the grain below the stored one
for _key, _attr in {"int_route_day": "route_day", "int_port_movement": "port_movement", "dim_route": "dim_route", "dim_route_pair": "dim_route_pair"}.items():

    def _from_records(spark, sf_dir, _attr=_attr):
        return getattr(_m(spark, sf_dir), _attr)

    register(_key, with_ctes(f"SELECT * FROM {_attr}", _attr))(_from_records)
