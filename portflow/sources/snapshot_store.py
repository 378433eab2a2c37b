"""A stored snapshot table whose upsert rewrites only what it touches.

The table is parquet, partitioned by ``bucket``, a hash of the merge key. An
upsert looks at its source's buckets first: of the table only those are read
(directories pruned), merged with ``snapshot_upsert`` and put in place of the
old ones by a dynamic partition overwrite. All other files stay as they are,
and so do touched buckets whose rows the merge leaves equal. Keys spread over
buckets by hash, so a chart that owns a third of all rows owns no directory.

The merged buckets are stored before the overwrite starts: a failed task or a
lost executor never reads a directory that is being replaced, and an upsert
that failed may be repeated (a merge with the same source changes nothing
more). Parquet has no transactions: writers must take turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from portflow.sources.sinks import SNAPSHOT_KEY, snapshot_upsert, through_storage

BUCKETS = 256


class SnapshotStore:
    """Snapshot rows under ``path``, in a fixed number of ``buckets`` at most.

    The number is a property of the stored table, part of its folder's name:
    an existing table is opened with the number it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.schema = spark, schema
        self.buckets = max(self._numbers(spark, path), default=0)
        if not self.buckets:
            raise ValueError(f"no snapshot table at {path}")
        self.path = f"{path.rstrip('/')}/of-{self.buckets}"

    @classmethod
    def create(cls, rows: DataFrame, path: str, buckets: int = BUCKETS) -> "SnapshotStore":
        """A new table with ``rows``; ``path`` must not hold one yet."""
        spark = rows.sparkSession
        if cls._numbers(spark, path):
            raise ValueError(f"there is a snapshot table at {path}")
        store = cls.__new__(cls)
        store.spark, store.schema, store.buckets, store.path = spark, rows.schema, buckets, f"{path.rstrip('/')}/of-{buckets}"
        store._write(rows.withColumn("bucket", store.bucket()), "static")
        return store

    @staticmethod
    def _numbers(spark: SparkSession, path: str) -> list[int]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return [int(n[3:]) for n in names if n.startswith("of-")]

    def bucket(self) -> Column:
        """The bucket of a row: its merge key's hash (a NULL filter hash is '')."""
        key = [F.coalesce(F.col(c), F.lit("")) if c == "filter_hash" else F.col(c) for c in SNAPSHOT_KEY]
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def stored(self) -> DataFrame:
        """The rows with their bucket."""
        full = StructType([*self.schema.fields]).add("bucket", IntegerType())
        return self.spark.read.schema(full).parquet(self.path)

    def read(self) -> DataFrame:
        return self.stored().drop("bucket")

    def upsert(self, source: DataFrame) -> list[int]:
        """Merge ``source`` into the table; returns the buckets that were rewritten.

        At most ``buckets`` small integers reach the driver. Rows of the source
        that match one row of the table twice are an error before anything is
        written.
        """
        source = through_storage(source.select(*self.schema.names).withColumn("bucket", self.bucket()), "upsert-source")
        touched = [r.bucket for r in source.select("bucket").distinct().collect()]
        if not touched:
            return []
        target = self.stored().where(F.col("bucket").isin(touched))
        merged = snapshot_upsert(target.drop("bucket"), source.drop("bucket"))
        merged = through_storage(merged.withColumn("bucket", self.bucket()), "upsert-merged")
        changed = self._changed(target, merged)
        if changed:
            self._write(merged.where(F.col("bucket").isin(changed)), "dynamic")
        return sorted(changed)

    def _changed(self, before: DataFrame, after: DataFrame) -> list[int]:
        """Buckets whose rows differ, by one aggregation: equal multisets of row hashes cancel out."""

        def rows(df: DataFrame, sign: int) -> DataFrame:
            return df.select("bucket", F.sha2(F.to_json(F.struct(*self.schema.names)), 256).alias("row"), F.lit(sign).alias("n"))

        both = rows(before, -1).unionByName(rows(after, 1)).groupBy("bucket", "row").agg(F.sum("n").alias("n"))
        return [r.bucket for r in both.where("n <> 0").select("bucket").distinct().collect()]

    def _write(self, rows: DataFrame, mode: str) -> None:
        # a bucket's rows in one place: a rewritten bucket is one file unless it is large
        w = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *SNAPSHOT_KEY)
        w.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("bucket").parquet(self.path)
