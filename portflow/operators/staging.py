"""Staging: typed, cleaned source rows (no dedup yet)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portflow.functions.text import clean_text, fold_port, unicode_trim

# A date literal must be exactly Y-M-D; Spark's cast would also accept
# '2026' or '2026-03-06T10:00' and turn them into dates.
DATE_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}$"
INT_PATTERN = r"^[+-]?\d+$"
# Texts that are their own trimmed form and, the numbers, in any case a long: they need no trimming.
# ``\z``, not ``$``, which also matches before a line end.
PLAIN_DATE = r"^\d{4}-\d{1,2}-\d{1,2}\z"
PLAIN_INT = r"^[+-]?\d{1,18}\z"
PLAIN_COUNT = r"^\d{1,18}\z"


def safe_date(c: Column) -> Column:
    t = unicode_trim(c)
    return F.when(c.rlike(PLAIN_DATE), c.try_cast("date")).otherwise(F.when(t.rlike(DATE_PATTERN), t.try_cast("date")))


def safe_int(c: Column) -> Column:
    """SAFE_CAST(x AS INTEGER): surrounding white space allowed, '12.0' / 'x' / '' → NULL."""
    t = unicode_trim(c)
    return F.when(c.rlike(PLAIN_INT), c.try_cast("long")).otherwise(F.when(t.rlike(INT_PATTERN), t.try_cast("long")))


def route_name_source() -> Column:
    """A row's route name before cleaning: the column, else the payload's."""
    payload = F.col("raw_payload")
    return F.coalesce(
        F.col("route_name"),
        F.get_json_object(payload, "$.routecodenames"),
        F.get_json_object(payload, "$.route_name"),
        F.get_json_object(payload, "$.route"),
    )


def stg_clean(raw: DataFrame, name_src: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """STG1–STG6: keep rows with a valid date; clean names, ports and counts.

    ``name_src``: the name to clean, where ``route_name_source`` was taken before; ``keep``: further columns to keep.
    """
    name_src = route_name_source() if name_src is None else name_src
    sd = safe_date(F.col("service_date"))
    return raw.where(sd.isNotNull()).select(
        F.col("record_hash"),
        F.col("record_hash").alias("source_record_id"),
        sd.alias("service_date"),
        clean_text(F.col("route_code")).alias("route_code"),
        clean_text(name_src).alias("route_name"),
        fold_port(F.col("departure_port")).alias("departure_port"),
        fold_port(F.col("arrival_port")).alias("arrival_port"),
        safe_int(F.col("passenger_count")).alias("passenger_count"),
        safe_int(F.col("vehicle_count")).alias("vehicle_count"),
        F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at"),
        F.col("raw_payload"),
        *keep,
    )
