"""Driver testdata (TPC-H-like star schema) → raw traffic records.

One traffic record per lineitem row:

* date            = order date (``yyyy-MM-dd``)
* routecode       = part brand, NULL when ``l_orderkey % 10 = 3``
* routecodenames  = ``p_type - p_name``, plus ``- <departure nation>`` when ``p_size % 3 = 0``
* departure port  = supplier nation, arrival port = customer nation
* passengercount  = quantity, vehiclecount = line number
* raw_payload     = canonical JSON (sorted keys, ``", "``/``": "`` separators, nulls kept)
* record_hash     = SHA-256 of the payload
* rows of orders with ``l_orderkey % 7 = 0`` are landed a second time, later,
  so the dedup has real copies to resolve.

The copies are produced by exploding an array of landing times, so the
star join runs once. Joins are plain equi-joins: Spark's size estimate and
AQE's runtime statistics choose broadcast only for sides under
``spark.sql.autoBroadcastJoinThreshold`` (nation, 25 rows); everything
else is a shuffle join that scales with the data.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Landing times of the first load and of the repeated load.
FIRST_LOAD_AT = _dt.datetime(2026, 1, 1, 6, 0, 0)
REPEAT_LOAD_AT = _dt.datetime(2026, 1, 2, 6, 0, 0)

# Fixed value: bytes of the lineitem file (some 400,000 rows) whose records one task makes and sorts.
BYTES_PER_TASK = 8_000_000

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

CHAIN_TABLES = "customer lineitem nation orders part supplier".split()  # what the traffic records are made of

RAW_COLUMNS = [
    "record_hash",
    "service_date",
    "route_code",
    "route_name",
    "departure_port",
    "arrival_port",
    "passenger_count",
    "vehicle_count",
    "ingested_at",
    "raw_payload",
]


def path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(path(sf_dir, name))


def record_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Into how many tasks the records are dealt: one a ``BYTES_PER_TASK`` of lineitem, one a core at least."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path(sf_dir, "lineitem"))
    size = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-size // BYTES_PER_TASK))


def _json_str(c):
    # The mapped fields hold no quotes, backslashes or control characters,
    # so a quoted string is canonical JSON; NULL becomes the literal null.
    return F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))


def star_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-shaped records (field names as the upstream API sends them)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date"))
    nation = table(spark, sf_dir, "nation")
    dep = nation.select(F.col("n_nationkey").alias("dep_key"), F.col("n_name").alias("dep_name"))
    arr = nation.select(F.col("n_nationkey").alias("arr_key"), F.col("n_name").alias("arr_name"))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")

    # Orders carry the arrival side; lineitem meets its supplier, then orders
    # on the order key (both sides shuffle on the same key), then part. Until
    # then a row holds numbers only; names come last, from 25 nations. What is
    # made of a row is many times larger than its numbers: the tasks that meet
    # part are counted by the input's size, not merged by that of the numbers.
    o = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_nationkey")
    j = (
        li.join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "s_nationkey")
        .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .repartition(record_tasks(spark, sf_dir), "l_partkey")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(dep, F.col("s_nationkey") == F.col("dep_key"))
        .join(arr, F.col("c_nationkey") == F.col("arr_key"))
    )
    name = F.concat(
        F.col("p_type"),
        F.lit(" - "),
        F.col("p_name"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" - "), F.col("dep_name"))).otherwise(F.lit("")),
    )
    return j.select(
        F.col("l_orderkey"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("l_orderkey") % 10 == 3, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("routecode"),
        name.alias("routecodenames"),
        F.col("dep_name").alias("departureportname"),
        F.col("arr_name").alias("arrivalportname"),
        F.col("l_quantity").cast("int").alias("passengercount"),
        F.col("l_linenumber").cast("int").alias("vehiclecount"),
    )


# Raw columns that ``raw_traffic`` deals records by where it deals them: equal payloads have them equal.
DEALT_BY = ("service_date", "route_code", "departure_port", "arrival_port")
_DEALT_FIELDS = ("date", "routecode", "departureportname", "arrivalportname")


def raw_traffic(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The raw landing table (all source fields as strings) built from testdata.

    ``dealt``: the records are dealt by ``DEALT_BY`` before they are hashed and
    landed again, so that the copies of a payload lie in one task and neither
    hash, payload nor copy travels to a dedup.
    """
    s = star_records(spark, sf_dir).withColumn("again", F.col("l_orderkey") % 7 == 0).drop("l_orderkey")
    if dealt:
        s = s.repartition(record_tasks(spark, sf_dir), *_DEALT_FIELDS)
    payload = F.concat(
        F.lit('{"arrivalportname": '), _json_str(F.col("arrivalportname")),
        F.lit(', "date": '), _json_str(F.col("date")),
        F.lit(', "departureportname": '), _json_str(F.col("departureportname")),
        F.lit(', "passengercount": '), F.coalesce(F.col("passengercount").cast("string"), F.lit("null")),
        F.lit(', "routecode": '), _json_str(F.col("routecode")),
        F.lit(', "routecodenames": '), _json_str(F.col("routecodenames")),
        F.lit(', "vehiclecount": '), F.coalesce(F.col("vehiclecount").cast("string"), F.lit("null")),
        F.lit("}"),
    )
    loads = F.when(
        F.col("again"),
        F.array(F.lit(FIRST_LOAD_AT).cast("timestamp_ntz"), F.lit(REPEAT_LOAD_AT).cast("timestamp_ntz")),
    ).otherwise(F.array(F.lit(FIRST_LOAD_AT).cast("timestamp_ntz")))
    return s.select(
        F.sha2(payload, 256).alias("record_hash"),
        F.col("date").alias("service_date"),
        F.col("routecode").alias("route_code"),
        F.col("routecodenames").alias("route_name"),
        F.col("departureportname").alias("departure_port"),
        F.col("arrivalportname").alias("arrival_port"),
        F.col("passengercount").cast("string").alias("passenger_count"),
        F.col("vehiclecount").cast("string").alias("vehicle_count"),
        F.explode(loads).alias("ingested_at"),
        payload.alias("raw_payload"),
    )
