"""The model chain: raw → stg → int_traffic_record → intermediates → marts → reports.

``TrafficModels`` builds each model lazily from its inputs and memoises the
DataFrame, so one query that needs a model twice (e.g. a full outer join of
two aggregates of the same facts) shares one sub-plan and Spark reuses the
exchange. Nothing is collected; every attribute is a DataFrame.

``materialize`` stores the chain once a session, partitioned by the month of
the date grain and clustered within files, and re-reads each table so
downstream models start from storage (lineage cut, executor loss costs one
table, not the chain).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portflow.functions.calendar import month_start
from portflow.operators import records as R
from portflow.operators import rollups as U
from portflow.operators.records import RECORD_COLUMNS
from portflow.operators.staging import stg_clean
from portflow.sources import testdata
from portflow.sources.sinks import scratch_path, write_table


class TrafficModels:
    def __init__(self, spark: SparkSession, sf_dir: str | None = None, raw: DataFrame | None = None, hash_of_payload: bool = False):
        """``hash_of_payload``: the hashes of ``raw`` are those of its payloads, as ``ingest.raw_rows`` makes them."""
        if raw is None and sf_dir is None:
            raise ValueError("need sf_dir or a raw DataFrame")
        self.spark = spark
        self.sf_dir = sf_dir
        self._raw = raw
        self._hashed = raw is None or hash_of_payload  # ``testdata.raw_traffic`` hashes the payload; a landing of the caller may hold any hash

    # --- source + cleaning ------------------------------------------------
    @cached_property
    def raw(self) -> DataFrame:
        return self._raw if self._raw is not None else testdata.raw_traffic(self.spark, self.sf_dir)

    @cached_property
    def _to_dedup(self) -> tuple[DataFrame, bool, tuple[str, ...]]:
        """The landing, whether its hash is its payload's, and what it is dealt by: ours brings the copies of a payload together."""
        if self._raw is not None:
            return self.raw, self._hashed, ()
        return testdata.raw_traffic(self.spark, self.sf_dir, dealt=True), True, testdata.DEALT_BY

    @cached_property
    def stg(self) -> DataFrame:
        return stg_clean(self.raw)

    @cached_property
    def records(self) -> DataFrame:
        return R.records_from_raw(*self._to_dedup)

    # --- intermediates ----------------------------------------------------
    @cached_property
    def route_day(self) -> DataFrame:
        return U.route_day_rows(self._route_day_sums)

    @cached_property
    def _route_day_sums(self) -> DataFrame:
        return U.route_day_sums(R.clean_from_raw(*self._to_dedup))

    @cached_property
    def port_movement(self) -> DataFrame:
        return U.int_port_movement(self.records)

    @cached_property
    def port_day(self) -> DataFrame:
        # Same rows as aggregating the port movements; one aggregation of the
        # (smaller) route-day grain instead of another pass over records.
        return U.port_day_from_route_day(self.route_day)

    # --- marts ------------------------------------------------------------
    @cached_property
    def dim_port(self) -> DataFrame:
        return U.dim_port(self.port_day)

    @cached_property
    def dim_route(self) -> DataFrame:
        return U.dim_route(self.records)

    @cached_property
    def dim_route_pair(self) -> DataFrame:
        return U.dim_route_pair(self.records)

    @cached_property
    def fct_route_daily(self) -> DataFrame:
        return U.fct_route_daily(self.route_day)

    @cached_property
    def fct_route_weekly(self) -> DataFrame:
        return U.route_period_of_days(self.route_day, "week")

    @cached_property
    def fct_route_monthly(self) -> DataFrame:
        return U.route_period_of_days(self.route_day, "month")

    @cached_property
    def fct_port_daily(self) -> DataFrame:
        return U.fct_port_daily(self.port_day)

    @cached_property
    def fct_port_weekly(self) -> DataFrame:
        return U.fct_port_weekly(self.fct_port_daily)

    @cached_property
    def fct_port_monthly(self) -> DataFrame:
        return U.fct_port_monthly(self.fct_port_daily)

    # --- reports ----------------------------------------------------------
    @cached_property
    def row_counts_daily(self) -> DataFrame:
        return U.row_counts_from_route_day(self.route_day, "daily")

    @cached_property
    def row_counts_weekly(self) -> DataFrame:
        return U.row_counts_from_route_day(self.route_day, "weekly")

    @cached_property
    def row_counts_monthly(self) -> DataFrame:
        return U.row_counts_from_route_day(self.route_day, "monthly")

    @cached_property
    def row_counts_yearly(self) -> DataFrame:
        return U.row_counts_from_route_day(self.route_day, "yearly")

    # --- day-grain inputs of the analytics layer ----------------------------
    @property
    def daily(self) -> DataFrame:
        return self.row_counts_daily

    @property
    def routes(self) -> DataFrame:
        return self.fct_route_daily.select(
            "service_date", "departure_port", "arrival_port", "traffic_record_count", "total_passengers", "total_vehicles"
        )

    @property
    def routes_by_month(self) -> DataFrame:
        """``routes`` with the month column that the stored route-day grain is partitioned by."""
        return self.route_day.select("service_month_start", *self.routes.columns)

    @property
    def ports(self) -> DataFrame:
        return self.fct_port_daily

    # --- materialisation ----------------------------------------------------
    def materialize(self, records: bool = False, payload: bool = True) -> "TrafficModels":
        """The chain with its route-day grain (and optionally the records) stored once and read back.

        Every day-grain table derives exactly from ``int_route_day``, so one
        chain run and one write feed them all, and every builder of a session
        that reads the same input files shares the stored tables: the first
        one writes them under the session's ``spark.checkpoint.dir`` (a shared
        folder on a cluster), ``drop_stored`` deletes them at the session's
        end. Route-day and records are partitioned by month (month
        directories, not thousands of day directories) and sorted by day
        within files, so scopes prune directories and skip row groups.
        Reading back cuts the lineage: later subqueries start from storage.

        Records are stored by what their other columns are made of; without
        ``payload`` that column is not stored and not among the records.
        """
        key = _input_key(self)
        stored = _STORED.setdefault(key, {}) if key else {}
        kept = "records" if payload else "records_without_payload"
        if records and kept not in stored:
            base = R.record_base(self.records if payload else self.records.drop("raw_payload"))
            rows = R.records_of_base(self._store("int_traffic_record", base, MONTH, ["service_date", "route_code", "route_name"]))
            stored[kept] = rows.select(*[c for c in RECORD_COLUMNS if c in rows.columns])
        if "route_day" not in stored:
            # from the stored records where there are some: the chain runs once
            rec = stored.get("records_without_payload", stored.get("records"))
            dealt = self.sf_dir is not None and self._raw is None
            if dealt and rec is not None:
                sums = U.dealt_route_day_sums(rec.withColumn("route_name", R.own_name()), (), testdata.record_tasks(self.spark, self.sf_dir))
            elif dealt:
                raw, hashed, dealt_by = self._to_dedup
                sums = U.dealt_route_day_sums(
                    R.clean_from_raw(raw, hashed, dealt_by), [R.DEALT + c for c in dealt_by], testdata.record_tasks(self.spark, self.sf_dir))
            else:
                sums = U.sums_of_records(rec) if rec is not None else self._route_day_sums
                sums = sums.withColumn(MONTH[0], month_start(F.col("service_date")))
            stored["route_day"] = self._store("int_route_day", sums, MONTH, ["service_date", "departure_port", "arrival_port"], U.route_day_rows, dealt)
            self.__dict__["route_day"] = stored["route_day"]
            # The two day-grain tables that analytics read over and over are
            # small (days, days × ports): stored too, from the stored grain.
            for attr, sort in (("row_counts_daily", ["service_date"]), ("port_day", ["service_date", "port_name"])):
                self.__dict__.pop(attr, None)
                stored[attr] = self._store(attr, getattr(self, attr), None, sort)
        for name in [k for k in self.__dict__ if k not in ("spark", "sf_dir", "_raw", "_hashed", "_to_dedup", "raw", "stg", "records")]:
            self.__dict__.pop(name)
        self.__dict__.update({k: v for k, v in stored.items() if not k.startswith("records")})
        if records:
            self.__dict__["records"] = stored[kept]
        return self

    def _store(self, name: str, df: DataFrame, partition_by: list[str] | None, cluster_by: list[str],
               finish: Callable[[DataFrame], DataFrame] | None = None, dealt: bool = False) -> DataFrame:
        path = scratch_path(self.spark, name)
        write_table(df, path, partition_by, cluster_by, finish=finish, dealt=dealt)
        _PATHS.append(path)
        schema = (finish(df) if finish else df).schema
        return self.spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


MONTH = ["service_month_start"]
_STORED: dict[tuple, dict[str, DataFrame]] = {}
_PATHS: list[str] = []


def _input_key(models: TrafficModels) -> tuple | None:
    """Session and input files (name, time, length) of a chain over the testdata; None for a chain over a DataFrame of the caller."""
    if models.sf_dir is None:
        return None
    jvm, conf = models.spark.sparkContext._jvm, models.spark.sparkContext._jsc.hadoopConfiguration()
    files = []
    for t in testdata.CHAIN_TABLES:
        path = jvm.org.apache.hadoop.fs.Path(testdata.path(models.sf_dir, t))
        found = path.getFileSystem(conf).listFiles(path, True)
        while found.hasNext():
            f = found.next()
            files.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))  # overwritten under its name: another input
    return models.spark.sparkContext.applicationId, models.sf_dir.rstrip("/"), tuple(sorted(files))


def drop_stored(spark: SparkSession) -> None:
    """Delete the stored chains of this process (their tables must not be read any more)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in _PATHS:
        folder = hadoop(path).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _PATHS.clear()
    _STORED.clear()


# Warehouse table name → TrafficModels attribute.
TABLE_ATTRS = {
    "raw_sailing_traffic": "raw",
    "stg_sailing_traffic": "stg",
    "int_traffic_record": "records",
    "int_route_day": "route_day",
    "int_port_movement": "port_movement",
    "int_port_day": "port_day",
    "dim_port": "dim_port",
    "dim_route": "dim_route",
    "dim_route_pair": "dim_route_pair",
    "fct_route_traffic_daily": "fct_route_daily",
    "fct_route_traffic_weekly": "fct_route_weekly",
    "fct_route_traffic_monthly": "fct_route_monthly",
    "fct_port_activity_daily": "fct_port_daily",
    "fct_port_activity_weekly": "fct_port_weekly",
    "fct_port_activity_monthly": "fct_port_monthly",
    "row_counts_daily": "row_counts_daily",
    "row_counts_weekly": "row_counts_weekly",
    "row_counts_monthly": "row_counts_monthly",
    "row_counts_yearly": "row_counts_yearly",
}
