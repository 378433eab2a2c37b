"""Data-quality checks: declared per table, counted as violating rows.

A check passes at 0 violations. Per table the runner evaluates every
row-level check (not_null, positive, non_negative, accepted_values) in ONE
aggregate pass of conditional sums, and each ``unique`` check as a group-by
on the key (extra rows beyond the first per key). Output rows:
``(table_name, column_name, check_name, violations, passed)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portflow.functions.keys import natural_pair_key, natural_route_key
from portflow.functions.text import unicode_trim
from portflow.operators.staging import PLAIN_COUNT, PLAIN_INT, safe_date, safe_int


def _route_fact(period: str) -> list[tuple[str, str]]:
    return [(period, "not_null"), ("route_key", "not_null"), ("route_pair_key", "not_null"),
            ("departure_port", "not_null"), ("arrival_port", "not_null"),
            ("traffic_record_count", "positive"), ("total_passengers", "non_negative"),
            ("total_vehicles", "non_negative")]


PORT_MEASURES = ["departure_record_count", "arrival_record_count", "total_departing_passengers",
                 "total_arriving_passengers", "total_departing_vehicles", "total_arriving_vehicles"]


def _port_fact(period: str) -> list[tuple[str, str]]:
    return [(period, "not_null"), ("port_name", "not_null")] + [(m, "non_negative") for m in PORT_MEASURES]


def _row_counts(period: str) -> list[tuple[str, str]]:
    return [(period, "not_null"), (period, "unique"), ("rows_count", "positive"),
            ("distinct_itineraries", "positive"), ("distinct_route_pairs", "positive"),
            ("total_passengers", "non_negative"), ("total_vehicles", "non_negative")]


# The declared checks of every model, (column, check) in declaration order.
CHECKS: dict[str, list[tuple[str, str]]] = {
    "raw_sailing_traffic": [("record_hash", "not_null")],
    "stg_sailing_traffic": [("passenger_count", "non_negative"), ("vehicle_count", "non_negative")],
    "int_traffic_record": [("event_id", "not_null"), ("event_id", "unique"), ("service_date", "not_null"),
                           ("route_key", "not_null"), ("route_pair_key", "not_null")],
    "int_route_day": _route_fact("service_date"),
    "int_port_movement": [("event_id", "not_null"), ("service_date", "not_null"), ("movement_type", "not_null"),
                          ("movement_type", "accepted_values"), ("port_name", "not_null"),
                          ("passenger_count", "non_negative"), ("vehicle_count", "non_negative")],
    "int_port_day": _port_fact("service_date"),
    "dim_port": [("port_name", "not_null"), ("port_name", "unique")],
    "dim_route": [("route_key", "not_null"), ("route_key", "unique")],
    "dim_route_pair": [("route_pair_key", "not_null"), ("route_pair_key", "unique"), ("route_key", "not_null"),
                       ("departure_port", "not_null"), ("arrival_port", "not_null"),
                       ("traffic_record_count", "positive")],
    "fct_route_traffic_daily": _route_fact("service_date"),
    "fct_route_traffic_weekly": _route_fact("week_start"),
    "fct_route_traffic_monthly": _route_fact("year_month"),
    "fct_port_activity_daily": _port_fact("service_date"),
    "fct_port_activity_weekly": _port_fact("week_start"),
    "fct_port_activity_monthly": _port_fact("year_month"),
    "row_counts_daily": _row_counts("service_date"),
    "row_counts_weekly": _row_counts("week_start"),
    "row_counts_monthly": _row_counts("year_month"),
    "row_counts_yearly": _row_counts("year"),
}

# Accepted movement types.
ACCEPTED_VALUES = {("int_port_movement", "movement_type"): ["departure", "arrival"]}


def _violation(table: str, column: str, check: str) -> Column:
    c = F.col(column)
    if check == "not_null":
        cond = c.isNull()
    elif check == "positive":
        cond = c <= 0
    elif check == "non_negative":
        cond = c < 0
    elif check == "accepted_values":
        cond = ~c.isin(*ACCEPTED_VALUES[(table, column)])
    else:
        raise ValueError(check)
    return F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("long")


def _result(table: str, column: str, check: str, violations: Column) -> list[Column]:
    return [F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), F.lit(check).alias("check_name"),
            violations.alias("violations")]


# Unique keys that are hashes and that no shuffle has dealt their table by.
HASH_KEYS = {("int_traffic_record", "event_id"), ("dim_route_pair", "route_pair_key")}


def _with_bytes(df: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    """``df`` with two columns that tell keys apart as ``key`` does: a hash by its 32 bytes, any other key as it is."""
    is_hash = F.col(key).rlike(r"^[0-9a-f]{64}\z")
    return df.withColumns({"_hash": F.when(is_hash, F.unhex(key)), "_other": F.when(~is_hash, F.col(key))}), ["_hash", "_other"]


def run_checks(table: str, df: DataFrame, checks: list[tuple[str, str]] | None = None) -> DataFrame:
    """Evaluate the declared checks of ``table`` on ``df``, in one pass over it.

    Row-level checks are conditional sums. Where a table has a ``unique``
    check, the sums are taken by its key first: a key's rows beyond the first
    are its violations, so the one shuffle that uniqueness needs serves all
    checks of the table (none, where the table is dealt by that key already).
    Further unique checks of one table have a pass of their own.
    """
    checks = CHECKS[table] if checks is None else checks
    unique = [c for c, k in checks if k == "unique"]
    key = unique[0] if unique else None
    names = {check: f"v{i}" for i, check in enumerate(checks)}
    sums = [_violation(table, c, k).alias(names[c, k]) for c, k in checks if k != "unique"]
    if key is None:
        one = df.agg(*sums)
    else:
        # a group has one key: its surplus rows, and the sums of its rows
        surplus = F.when(F.col(key).isNotNull(), F.count(F.lit(1)) - 1).otherwise(0).alias(names[key, "unique"])
        rows, keys = df, [key]
        if (table, key) in HASH_KEYS:
            rows, keys = _with_bytes(df, key)
            surplus = F.when(F.col(keys[0]).isNotNull() | F.col(keys[1]).isNotNull(), F.count(F.lit(1)) - 1).otherwise(0).alias(names[key, "unique"])
        by_key = rows.groupBy(*keys).agg(surplus, *sums).drop(*keys)
        one = by_key.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in by_key.columns])
    stack = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("check_name"), F.col(names[c, k]).alias("violations"))
        for c, k in checks if k != "unique" or c == key
    ])
    out = one.select(F.inline(stack)).select(F.lit(table).alias("table_name"), "column_name", "check_name", "violations")
    for c in unique[1:]:
        again = run_checks(table, df, [(c, "unique")])
        out = out.unionByName(again.drop("passed"))
    return out.withColumn("passed", F.col("violations") == 0)


# --- custom checks -----------------------------------------------------------

def cast_dropped(field: str) -> Column:
    """DQ6/DQ7 condition: the payload has a valid date and a non-empty value that does not cast to a whole number.

    A plain whole number casts, whatever the date: only other values are trimmed and have their date read.
    """
    p = F.col("raw_payload")
    v = F.get_json_object(p, f"$.{field}")
    dropped = (
        safe_date(F.get_json_object(p, "$.date")).isNotNull()
        & F.nullif(unicode_trim(v), F.lit("")).isNotNull()
        & safe_int(v).isNull()
    )
    return F.when(v.rlike(PLAIN_INT), F.lit(False)).otherwise(dropped)


def _dropped(field: str) -> Column:
    return F.coalesce(F.sum(F.when(cast_dropped(field), 1).otherwise(0)), F.lit(0)).cast("long")


def safe_cast_dropped(raw: DataFrame, field: str) -> DataFrame:
    """DQ6/DQ7: raw rows whose value the safe cast dropped."""
    return raw.agg(_dropped(field).alias("violations"))


def safe_casts_dropped(raw: DataFrame, fields: dict[str, str]) -> DataFrame:
    """DQ6/DQ7 of several fields in one pass: a row (column_name, violations) for each payload field → column."""
    one = raw.agg(*[_dropped(f).alias(c) for f, c in fields.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("violations")) for c in fields.values()])))


def collision_checks(rec: DataFrame) -> DataFrame:
    """DQ8–DQ10: keys that map to more than one natural value, in one pass over the records.

    Two values are there when the least is not the greatest, so no distinct
    count is needed: one aggregation by both keys (map-side combine leaves a
    row a key pair), then each key is looked at on that small table.
    """
    code, name, dep, arr = (F.col(c) for c in ("route_code", "route_name", "departure_port", "arrival_port"))
    values = {"route": natural_route_key(code, name, dep, arr), "pair": natural_pair_key(code, name, dep, arr)}
    ends = [f(v).alias(f"{n}_{w}") for n, v in values.items() for w, f in (("lo", F.min), ("hi", F.max))]
    keys = rec.groupBy("route_pair_key", "route_key").agg(*ends)

    def differ(lo: str, hi: str) -> Column:
        return (F.min(lo) != F.max(hi)).cast("long")

    by_route = keys.groupBy("route_key").agg(differ("route_lo", "route_hi").alias("route"))
    by_pair = keys.groupBy("route_pair_key").agg(
        differ("pair_lo", "pair_hi").alias("pair"), differ("route_key", "route_key").alias("single"))
    rows = [
        (by_route, "route", "route_key", "route_key_has_no_hash_collisions"),
        (by_pair, "pair", "route_pair_key", "route_pair_key_has_no_hash_collisions"),
        (by_pair, "single", "route_pair_key", "route_pair_key_maps_to_single_route_key"),
    ]
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    frames = []
    for df in (by_route, by_pair):
        mine = [(c, k, name) for d, c, k, name in rows if d is df]
        one = df.agg(*[count(c).alias(c) for c, _, _ in mine])
        frames.append(one.select(F.inline(F.array(*[F.struct(*_result("int_traffic_record", k, name, F.col(c))) for c, k, name in mine]))))
    return reduce(DataFrame.unionByName, frames).withColumn("passed", F.col("violations") == 0)


def custom_checks(raw: DataFrame, rec: DataFrame) -> DataFrame:
    """DQ6–DQ10: the safe casts in one pass over the landing table, the key collisions in one over the records."""
    casts = landing_checks(raw).where(F.col("check_name").contains("safe_cast"))
    return casts.unionByName(collision_checks(rec))


def landing_checks(raw: DataFrame) -> DataFrame:
    """Raw-table, staging and safe-cast checks in ONE aggregation over the landing table.

    Staging is a row-wise function of raw (valid-date filter + casts), so its
    checks — and the two custom safe-cast checks, which read the payload —
    are conditional sums over the same scan; no second pass over the landing.
    """
    staged = safe_date(F.col("service_date")).isNotNull()

    def negative(c: str) -> Column:
        # a count of digits alone is none, whatever the date
        return F.when(F.col(c).rlike(PLAIN_COUNT), F.lit(False)).otherwise(staged & (safe_int(F.col(c)) < 0))

    def cnt(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("long")

    rows = [
        ("raw_sailing_traffic", "record_hash", "not_null", F.col("record_hash").isNull()),
        ("stg_sailing_traffic", "passenger_count", "non_negative", negative("passenger_count")),
        ("stg_sailing_traffic", "vehicle_count", "non_negative", negative("vehicle_count")),
        ("stg_sailing_traffic", "passenger_count", "passenger_count_safe_cast_did_not_drop_values", cast_dropped("passengercount")),
        ("stg_sailing_traffic", "vehicle_count", "vehicle_count_safe_cast_did_not_drop_values", cast_dropped("vehiclecount")),
    ]
    one = raw.agg(*[cnt(c).alias(f"v{i}") for i, (_, _, _, c) in enumerate(rows)])
    stack = F.array(*[
        F.struct(F.lit(t).alias("table_name"), F.lit(col).alias("column_name"), F.lit(k).alias("check_name"),
                 F.col(f"v{i}").alias("violations"))
        for i, (t, col, k, _) in enumerate(rows)
    ])
    return one.select(F.inline(stack)).withColumn("passed", F.col("violations") == 0)
