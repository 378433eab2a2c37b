"""Canonical traffic record: dedup by payload hash, surrogate keys, calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portflow.functions.calendar import month_start, season, week_start
from portflow.functions.keys import route_key, route_pair_key

DEALT = "_dealt_"  # before the name of a raw column that rows are dealt by, where the cleaned one stands beside it
RECORD_COLUMNS = [
    "event_id",
    "source_record_id",
    "service_date",
    "service_week_start",
    "service_month_start",
    "service_year",
    "service_month",
    "service_season",
    "route_key",
    "route_pair_key",
    "route_code",
    "route_name",
    "departure_port",
    "arrival_port",
    "passenger_count",
    "vehicle_count",
    "ingested_at",
    "raw_payload",
]


def dedup_latest(stg: DataFrame, hash_of_payload: bool = False, dealt_by: Sequence[str] = ()) -> DataFrame:
    """REC1: one row per ``record_hash``, the newest landing (then the largest payload).

    ``hash_of_payload``: every ``record_hash`` is the lower-hex SHA-256 of its
    row's payload, so copies have one payload and need no tie-break: a payload
    that nobody reads is not carried along, and the hash travels as 32 bytes.
    ``dealt_by``: columns that copies of a payload have in common; rows that are
    dealt by them already are not shuffled.

    ``row_number() = 1`` is planned as a partial ``WindowGroupLimit`` before
    the shuffle and a final one after it, so a hash repeated millions of
    times ships at most one row per map task — a hot copy group does not
    land in one reducer whole.
    """
    if hash_of_payload:
        w = Window.partitionBy("_hash", *dealt_by).orderBy(F.col("ingested_at").desc())
        packed = stg.withColumn("_hash", F.unhex("record_hash")).drop("record_hash")
        newest = packed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
        return newest.withColumn("record_hash", F.lower(F.hex("_hash"))).select(*stg.columns)
    w = Window.partitionBy("record_hash").orderBy(F.col("ingested_at").desc(), F.col("raw_payload").desc())
    return stg.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def with_keys(df: DataFrame) -> DataFrame:
    """REC2/REC3: route_key and route_pair_key (lower-hex SHA-256)."""
    code, name, dep, arr = (F.col(c) for c in ("route_code", "route_name", "departure_port", "arrival_port"))
    return df.withColumn("route_key", route_key(code, name, dep, arr)).withColumn(
        "route_pair_key", route_pair_key(code, name, dep, arr)
    )


def clean_from_raw(raw: DataFrame, hash_of_payload: bool = False, dealt_by: Sequence[str] = ()) -> DataFrame:
    """Deduplicated, cleaned rows (staging columns) straight from the landing table.

    Same result as ``dedup_latest(stg_clean(raw))``: the dedup orders by
    raw fields only and cleaning is row-wise, so valid-date filter → dedup →
    clean is equivalent, and the cleaning (regular expressions on four text
    columns) runs after the dedup shuffle, on deduplicated rows, spread over
    the shuffle partitions whatever the input partitioning. The columns of
    ``dealt_by`` stay beside the cleaned ones, as they were (``DEALT``).
    """
    from portflow.operators.staging import route_name_source, safe_date, stg_clean

    # the name is looked up before, so that only those who ask for the payload carry it through the shuffle
    valid = raw.where(safe_date(F.col("service_date")).isNotNull()).withColumn("route_name", route_name_source())
    valid = valid.withColumns({DEALT + c: F.col(c) for c in dealt_by})
    dealt = [DEALT + c for c in dealt_by]
    return stg_clean(dedup_latest(valid, hash_of_payload, dealt), F.col("route_name"), dealt)


def records_from_raw(raw: DataFrame, hash_of_payload: bool = False, dealt_by: Sequence[str] = ()) -> DataFrame:
    """The canonical record straight from the landing table: ``int_traffic_record(stg_clean(raw))``."""
    return int_traffic_record(clean_from_raw(raw, hash_of_payload, dealt_by), deduplicated=True)


def shown_name() -> Column:
    """REC4: a record's route name, else its corridor."""
    return F.coalesce(
        F.col("route_name"),
        F.concat(
            F.coalesce(F.col("departure_port"), F.lit("Unknown departure")),
            F.lit(" -> "),
            F.coalesce(F.col("arrival_port"), F.lit("Unknown arrival")),
        ),
    )


def nameless() -> Column:
    """Whether a cleaned row has neither code nor name, so that its keys are made of the ports."""
    return F.col("route_code").isNull() & F.col("route_name").isNull()


def int_traffic_record(stg: DataFrame, deduplicated: bool = False) -> DataFrame:
    """REC1–REC6 → the canonical record table (schema ``RECORD_COLUMNS``)."""
    d = F.col("service_date")
    keyed = with_keys(stg if deduplicated else dedup_latest(stg))
    return keyed.select(
        F.col("record_hash").alias("event_id"),
        "source_record_id",
        "service_date",
        week_start(d).alias("service_week_start"),
        month_start(d).alias("service_month_start"),
        F.year(d).alias("service_year"),
        F.month(d).alias("service_month"),
        season(d).alias("service_season"),
        "route_key",
        "route_pair_key",
        "route_code",
        shown_name().alias("route_name"),
        "departure_port",
        "arrival_port",
        "passenger_count",
        "vehicle_count",
        "ingested_at",
        "raw_payload",
    )


def record_base(rec: DataFrame) -> DataFrame:
    """A canonical record by the columns that its others are made of; an id that is a hash as its 32 bytes."""
    is_hash = F.col("event_id").rlike(r"^[0-9a-f]{64}\z")
    made = {
        "hash": F.when(is_hash, F.unhex("event_id")),
        "id": F.when(~is_hash, F.col("event_id")),
        "nameless": F.col("route_code").isNull() & (F.col("route_pair_key") == nameless_pair_key()),
    }
    others = [c for c in ("service_date", "service_month_start", "route_code", "route_name", "departure_port", "arrival_port",
                          "passenger_count", "vehicle_count", "ingested_at", "raw_payload") if c in rec.columns]
    return rec.withColumns(made).select(*made, *others)


def records_of_base(base: DataFrame) -> DataFrame:
    """Canonical records from ``record_base``."""
    d, code, dep, arr = (F.col(c) for c in ("service_date", "route_code", "departure_port", "arrival_port"))
    name = F.when(~F.col("nameless"), F.col("route_name"))
    event_id = F.coalesce(F.lower(F.hex("hash")), F.col("id"))
    made = {
        "event_id": event_id, "source_record_id": event_id, "service_week_start": week_start(d), "service_year": F.year(d),
        "service_month": F.month(d), "service_season": season(d),
        "route_key": route_key(code, name, dep, arr), "route_pair_key": route_pair_key(code, name, dep, arr),
    }
    return base.withColumns(made).select(*[c for c in RECORD_COLUMNS if c in made or c in base.columns])


def nameless_pair_key() -> Column:
    """The pair key of a record that has neither code nor name."""
    no_name = F.lit(None).cast("string")
    return route_pair_key(no_name, no_name, F.col("departure_port"), F.col("arrival_port"))


def own_name() -> Column:
    """A canonical record's route name, unless its ports gave it."""
    return F.when(~(F.col("route_code").isNull() & (F.col("route_pair_key") == nameless_pair_key())), F.col("route_name"))
