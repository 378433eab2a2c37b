"""Surrogate keys of the canonical record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_route_key(code: Column, name: Column, dep: Column, arr: Column) -> Column:
    """Itinerary natural key: code, else name, else an ``unknown_itinerary|dep|arr`` tag."""
    fallback = F.concat(
        F.lit("unknown_itinerary|"),
        F.coalesce(dep, F.lit("unknown_departure")),
        F.lit("|"),
        F.coalesce(arr, F.lit("unknown_arrival")),
    )
    return F.coalesce(code, name, fallback)


def natural_pair_key(code: Column, name: Column, dep: Column, arr: Column) -> Column:
    # concat + coalesce, not concat_ws: concat_ws would silently drop NULL parts.
    return F.concat(
        F.coalesce(code, name, F.lit("")),
        F.lit("|"),
        F.coalesce(dep, F.lit("")),
        F.lit("|"),
        F.coalesce(arr, F.lit("")),
    )


def route_key(code: Column, name: Column, dep: Column, arr: Column) -> Column:
    """Lower-hex SHA-256 of the itinerary natural key."""
    return F.sha2(natural_route_key(code, name, dep, arr), 256)


def route_pair_key(code: Column, name: Column, dep: Column, arr: Column) -> Column:
    """Lower-hex SHA-256 of ``route|dep|arr`` with NULL parts as ''."""
    return F.sha2(natural_pair_key(code, name, dep, arr), 256)


def pair_label(dep: Column, arr: Column, unknown: str = "Unknown") -> Column:
    """Corridor label ``dep -> arr`` with NULL ends shown as ``unknown``."""
    return F.concat(F.coalesce(dep, F.lit(unknown)), F.lit(" -> "), F.coalesce(arr, F.lit(unknown)))
