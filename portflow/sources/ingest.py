"""Ingest: landed API responses → records → raw landing rows; window planning and audit.

* ``extract_records`` (SRC1): a response is a JSON list, or an object whose
  first PRESENT key among records/results/data holds a list; non-object
  elements are dropped; any other shape is quarantined with a reason (or
  raised with ``strict=True``). Shapes are told by Spark's VARIANT type, so no
  record schema has to be known up front; a record itself is kept as text.
* ``raw_rows`` (SRC2): canonical JSON (sorted keys, nulls kept, numbers as
  landed: ``12.0`` is not ``12``) and its SHA-256 as ``record_hash``; source
  fields as strings; one ``ingested_at`` per load.
* ``plan_windows`` (SRC3): inclusive request windows, both bounds shifted back
  by the source lag, chained month/year steps, last window clipped.
* ``audit_windows`` (SRC4): rows landed per window, empty windows, totals.

The HTTP client, retries and replay passes of the reference are not built:
landed files are the input here (see README).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from portflow.functions.canonical import canonical_json
from portflow.sources.sinks import append_landing, freed_shuffles, scratch_path, through_storage

# Wrapper keys tried in order, source field → raw column.
WRAPPER_KEYS = ("records", "results", "data")
FIELD_MAP = (
    ("date", "service_date"),
    ("routecode", "route_code"),
    ("routecodenames", "route_name"),
    ("departureportname", "departure_port"),
    ("arrivalportname", "arrival_port"),
    ("passengercount", "passenger_count"),
    ("vehiclecount", "vehicle_count"),
)
SOURCE_FIELDS = [f for f, _ in FIELD_MAP]


def read_payloads(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Landed responses: one per line (JSON Lines of payloads) or one per file."""
    df = spark.read.text(path, wholetext=whole_files)
    return df.select(F.col("value").alias("payload"), F.input_file_name().alias("source_file"))


def extract_records(payloads: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """SRC1 → (records as JSON text in ``record``, quarantined payloads with ``reason``)."""
    v = F.try_parse_json(F.col("payload"))
    typed = payloads.withColumn("_v", v).withColumn("_t", F.schema_of_variant("_v"))
    present = [F.try_variant_get(F.col("_v"), f"$.{k}", "variant") for k in WRAPPER_KEYS]
    chosen = F.when(F.col("_t").startswith("ARRAY"), F.col("_v")).when(F.col("_t").startswith("OBJECT"), F.coalesce(*present))
    typed = typed.withColumn("_arr", F.try_variant_get(chosen, "$", "array<variant>"))
    reason = (
        F.when(F.col("_v").isNull(), F.lit("not valid JSON"))
        .when(~F.col("_t").startswith("ARRAY") & ~F.col("_t").startswith("OBJECT"), F.concat(F.lit("expected list or dict, got "), F.col("_t")))
        .when(chosen.isNull(), F.lit("expected one of records/results/data keys"))
        .when(F.col("_arr").isNull(), F.lit("wrapped value is not a list"))
    )
    typed = typed.withColumn("reason", reason)
    if strict:
        # A filter keeps the check in the plan (an unused column would be pruned).
        fail = F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("Unexpected response: "), F.col("reason"))))
        typed = typed.where(fail.isNull())
    bad = typed.where(F.col("reason").isNotNull()).select("payload", "source_file", "reason")
    # The same elements as text: VARIANT tells their types, the text keeps their numbers (a VARIANT stores 12.0 as 12).
    wrapped = F.from_json("payload", ", ".join(f"{k} string" for k in WRAPPER_KEYS))
    listed = F.when(F.col("_t").startswith("ARRAY"), F.col("payload")).otherwise(F.coalesce(*[wrapped[k] for k in WRAPPER_KEYS]))
    both = F.arrays_zip(F.transform("_arr", F.schema_of_variant).alias("kind"), F.from_json(listed, "array<string>").alias("record"))
    recs = (
        typed.where(F.col("reason").isNull())
        .select("source_file", F.explode(both).alias("e"))
        .where(F.col("e.kind").startswith("OBJECT"))
        .select("source_file", F.col("e.record").alias("record"))
    )
    return recs, bad


def raw_rows(records: DataFrame, ingested_at: _dt.datetime | Column) -> DataFrame:
    """SRC2: records → raw landing rows (all source fields as strings)."""
    ts = ingested_at if isinstance(ingested_at, Column) else F.lit(ingested_at).cast("timestamp_ntz")
    p = F.col("raw_payload")
    return records.select(canonical_json(F.col("record")).alias("raw_payload")).select(
        F.sha2(p, 256).alias("record_hash"),
        *[F.get_json_object(p, f"$.{src}").alias(dst) for src, dst in FIELD_MAP],
        ts.alias("ingested_at"),
        p,
    )


def records_as_fields(records: DataFrame) -> DataFrame:
    """The source fields of extracted records, as strings (for inspection and tests)."""
    return records.select(*[F.get_json_object("record", f"$.{f}").alias(f) for f in SOURCE_FIELDS])


# --- landing files from the testdata -------------------------------------------------------------

ODD_EVERY, ODD_AT = 97, 5  # orders whose records land in an awkward form
RECORDS_PER_TASK = 400_000  # fixed value: records whose payloads one task makes


def _record_text(odd: bool) -> Column:
    """A source record as JSON text; with ``odd``, some have decimal counts, a nested field and Greek text."""
    plain = F.to_json(F.struct(*[F.col(f) for f in SOURCE_FIELDS]), {"ignoreNullFields": "false"})
    if not odd:
        return plain
    q = lambda f: F.coalesce(F.concat(F.lit('"'), F.col(f), F.lit('"')), F.lit("null"))
    awkward = F.concat(
        F.lit('{"routecode":'), q("routecode"), F.lit(',"vehiclecount":1e2,"passengercount":'), F.col("passengercount").cast("string"),
        F.lit('.0, "meta": {"z": 1.50, "a": ["q", null, true]}, "departureportname":"Πειραιάς","arrivalportname":'), q("arrivalportname"),
        F.lit(',"routecodenames":'), q("routecodenames"), F.lit(',"date":'), q("date"), F.lit("}"),
    )
    return F.when(F.col("odd"), awkward).otherwise(plain)


def _bad_payloads(days: DataFrame) -> DataFrame:
    """A payload of a wrong shape for each day of the records, five kinds by the day of the month."""
    kinds = ['{"records": [', '"text"', '{"other": []}', '{"data": {"a": 1}}', '{"records": null, "data": [{"date": "x"}]}']
    day = F.dayofmonth(F.col("date").cast("date"))
    return days.select(F.element_at(F.array(*map(F.lit, kinds)), F.pmod(day, F.lit(5)) + 1).alias("value"))


def land_payloads(star: DataFrame, path: str, records_per_payload: int = 500, odd: bool = False, bad: bool = False) -> None:
    """Write source records as API-shaped payloads, one payload per line.

    Records are grouped per day and per hash bucket, with the bucket count
    per day chosen from that day's size, so every payload holds about
    ``records_per_payload`` records however skewed the days are. Shapes
    rotate over list / records / results / data wrappers, and list payloads
    carry one non-object element that extraction must drop. ``odd`` lands
    some records in an awkward form, ``bad`` adds payloads of wrong shapes.

    The days' sizes, a row a day, are stored first: the records then meet them
    without a shuffle, and are shuffled once, as fields. Their texts are made
    where the payloads are, and the files are packed.
    """
    per_day = through_storage(star.groupBy("date").agg(F.count(F.lit(1)).alias("n")), "days-to-land")
    tasks = max(star.sparkSession.sparkContext.defaultParallelism, -(-(per_day.agg(F.sum("n")).first()[0] or 0) // RECORDS_PER_TASK))
    buckets = per_day.select("date", (F.floor(F.col("n") / records_per_payload) + 1).cast("int").alias("buckets"))
    keyed = star.join(buckets, "date").select(
        *SOURCE_FIELDS, F.pmod(F.xxhash64(*SOURCE_FIELDS, "l_orderkey"), F.col("buckets")).alias("bucket"),
        (F.col("l_orderkey") % ODD_EVERY == ODD_AT).alias("odd")).repartition(tasks, "date", "bucket")
    body = F.concat(F.lit("["), F.array_join(F.collect_list(_record_text(odd)), ","), F.lit("]"))
    grouped = keyed.groupBy("date", "bucket").agg(body.alias("arr"))
    shape = F.pmod(F.xxhash64("date", "bucket"), F.lit(4))
    payload = (
        F.when(shape == 0, F.concat(F.lit("["), F.expr("substring(arr, 2, length(arr) - 2)"), F.lit(", 0]")))
        .when(shape == 1, F.concat(F.lit('{"records": '), F.col("arr"), F.lit("}")))
        .when(shape == 2, F.concat(F.lit('{"results": '), F.col("arr"), F.lit(', "page": 1}')))
        .otherwise(F.concat(F.lit('{"data": '), F.col("arr"), F.lit("}")))
    )
    out = grouped.select(payload.alias("value"))
    out = out.unionByName(_bad_payloads(per_day)) if bad else out
    with freed_shuffles(star.sparkSession):
        out.write.mode("overwrite").option("compression", "gzip").text(path)


# --- SRC3 / SRC4: request windows ---------------------------------------------------------------------

def plan_windows(bounds: DataFrame, unit: str = "month", size: int = 8, lag_days: int = 0) -> DataFrame:
    """SRC3: ``bounds`` has one row (start_date, end_date) → (window_index, window_start, window_end).

    Day windows step with ``sequence``; month/year windows are CHAINED
    (each start is the previous start plus ``size`` units, so Jan 31 → Feb 29
    → Mar 29), computed with ``aggregate`` over a step counter. Start after
    end is an error.
    """
    if unit not in {"day", "month", "year"}:
        raise ValueError("request_window_unit must be one of: day, month, year")
    if size < 1:
        raise ValueError("request_window_size must be >= 1")
    if lag_days < 0:
        raise ValueError("source_data_lag_days must be >= 0")
    s = F.date_sub(F.col("start_date"), lag_days)
    e = F.date_sub(F.col("end_date"), lag_days)
    b = bounds.select(s.alias("s"), e.alias("e")).withColumn(
        "_chk", F.when(F.col("s") > F.col("e"), F.raise_error(F.lit("start date must be <= end date"))))
    if unit == "day":
        starts = F.sequence(F.col("s"), F.col("e"), F.expr(f"INTERVAL {size} DAYS"))
        w = b.select("e", F.posexplode(starts).alias("i", "ws"))
        return w.select(
            F.col("i").alias("window_index"), F.col("ws").alias("window_start"),
            F.least(F.date_add(F.col("ws"), size - 1), F.col("e")).alias("window_end"))
    months = size * (12 if unit == "year" else 1)
    n = (F.floor(F.months_between(F.col("e"), F.col("s")) / months) + 2).cast("int")  # upper bound on windows
    chained = lambda i: F.aggregate(F.sequence(F.lit(0), i), F.col("s"),
                                    lambda acc, k: F.when(k == 0, acc).otherwise(F.add_months(acc, months)))
    w = b.select("s", "e", F.explode(F.sequence(F.lit(0), n)).alias("i"))
    w = w.select("e", "i", chained(F.col("i")).alias("ws"), chained(F.col("i") + 1).alias("next_ws")).where(F.col("ws") <= F.col("e"))
    return w.select(
        F.col("i").alias("window_index"), F.col("ws").alias("window_start"),
        F.least(F.date_sub(F.col("next_ws"), 1), F.col("e")).alias("window_end"))


def landed_days(raw: DataFrame) -> DataFrame:
    """d, n: landed rows per valid service date, by map-side combine; of the landing only the date is read."""
    d = F.col("service_date").try_cast("date")
    return raw.select(d.alias("d")).where(F.col("d").isNotNull()).groupBy("d").agg(F.count(F.lit(1)).alias("n"))


def audit_windows(windows: DataFrame, raw: DataFrame) -> DataFrame:
    """SRC4: rows landed per planned window, empty or loaded, with run totals."""
    return audit_days(windows, landed_days(raw))


def audit_days(windows: DataFrame, days: DataFrame) -> DataFrame:
    """SRC4 from ``landed_days``.

    Windows are disjoint and cover a bounded calendar span, so each day maps
    to at most one window: a day → window calendar (one row per day of the
    span) turns the range condition into an equi-join on the date.
    """
    cal = windows.select("window_index", F.explode(F.sequence("window_start", "window_end")).alias("d"))
    counts = days.join(cal, "d").groupBy("window_index").agg(F.sum("n").alias("rows_loaded"))
    return _audited(windows.join(counts, "window_index", "left"))


def _audited(counted: DataFrame) -> DataFrame:
    """Status and run totals of windows with ``rows_loaded``."""
    out = counted.withColumn("rows_loaded", F.coalesce(F.col("rows_loaded"), F.lit(0)).cast("long"))
    tot = Window.partitionBy()  # window grain: bounded by the planned windows
    return out.select(
        "window_index", "window_start", "window_end", "rows_loaded",
        F.when(F.col("rows_loaded") == 0, "empty").otherwise("loaded").alias("status"),
        F.count(F.lit(1)).over(tot).alias("total_windows"),
        F.sum(F.when(F.col("rows_loaded") == 0, 1).otherwise(0)).over(tot).alias("empty_windows"),
        F.sum("rows_loaded").over(tot).alias("total_rows"),
    )


MAX_OBSERVED = 400  # windows that are counted while writing: metrics that every task carries


def land_and_audit(raw: DataFrame, path: str, windows: DataFrame) -> DataFrame:
    """SRC4 at load time: append ``raw`` to ``path`` and return its audit, with ``rows_written``.

    The windows are counted as observed metrics of the write itself, so the
    audit reads no data again. A task that ran twice could count twice: the
    number of rows observed is held against the row counts that the written
    files state, and if they differ, or if there are more than
    ``MAX_OBSERVED`` windows, the audit is taken from the written files.
    """
    planned = [(w.window_index, w.window_start, w.window_end) for w in windows.limit(MAX_OBSERVED + 1).collect()]
    d = F.col("service_date").try_cast("date")
    seen = Observation()
    few = len(planned) <= MAX_OBSERVED
    counts = [F.count_if(d.between(F.lit(a), F.lit(b))).alias(f"w{i}") for i, a, b in planned] if few else []
    spark = raw.sparkSession
    before = spark.read.schema(raw.schema).parquet(path).count() if _there(spark, path) else 0  # row counts are in the footers
    append = raw.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
    append_landing(append, path)
    got, stored = seen.get, spark.read.schema(raw.schema).parquet(path)
    written = stored.count() - before
    if few and got["rows"] == written:
        pairs = F.map_from_arrays(F.array(*[F.lit(i) for i, _, _ in planned]).cast("array<int>"), F.array(*[F.lit(got[f"w{i}"]) for i, _, _ in planned]).cast("array<bigint>"))
        counted = windows.withColumn("rows_loaded", F.element_at(pairs, F.col("window_index").cast("int"))) if planned else windows.withColumn("rows_loaded", F.lit(0))
        audit = _audited(counted)
    else:
        audit = audit_windows(windows, stored if before == 0 else raw)
    return audit.withColumn("rows_written", F.lit(written).cast("long"))


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
