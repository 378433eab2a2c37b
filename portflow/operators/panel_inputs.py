"""PAN-B: the panel's three input frames, made alike whatever their origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portflow.functions.text import unicode_trim

# Frames of any origin: a date or number that is text is read if it can be, a bad date drops the row, a bad, missing or
# absent number is 0, a missing or absent name is 'Unknown'.

def dated(df: DataFrame) -> DataFrame:
    d = F.col("service_date")
    if dict(df.dtypes)["service_date"] == "string":
        d = unicode_trim(d).try_cast("date")
    return df.withColumn("service_date", d).where(F.col("service_date").isNotNull())


def _number(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes).get(name)
    if kind is None:
        return F.lit(0).cast("long")
    c = unicode_trim(F.col(name)).try_cast("double") if kind == "string" else F.col(name)
    return F.coalesce(F.when(~F.isnan(c.cast("double")), c), F.lit(0)).cast("long")


def _name(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("Unknown")) if name in df.columns else F.lit("Unknown")


def prepare_daily(daily: DataFrame) -> DataFrame:
    return dated(daily).select(
        "service_date", *[_number(daily, c).alias(c) for c in ("rows_count", "total_passengers", "total_vehicles")]
    )


def prepare_routes(routes: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Corridor rows; ``keep`` names further columns to carry along."""
    return dated(routes).select(
        "service_date", *keep,
        *[_name(routes, c).alias(c) for c in ("departure_port", "arrival_port")],
        *[_number(routes, c).alias(c) for c in ("total_passengers", "total_vehicles")],
    )


def prepare_ports(ports: DataFrame, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Port rows, both directions added up; ``keep`` names further columns to carry along."""
    both = _number(ports, "total_departing_passengers") + _number(ports, "total_arriving_passengers")
    return dated(ports).select("service_date", *keep, _name(ports, "port_name").alias("port_name"), both.alias("total_passengers"))
