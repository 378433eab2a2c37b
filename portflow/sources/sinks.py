"""Sinks: full-replace tables, append landing, snapshot upsert."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The snapshot table's merge key (NULL filter hash ≡ '').
SNAPSHOT_KEY = ["chart_id", "insight_type", "data_version", "filter_hash"]


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files behind: a finished write is never read through its shuffles again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, cluster_by: list[str] | None = None,
                mode: str = "overwrite", finish: Callable[[DataFrame], DataFrame] | None = None, dealt: bool = False) -> None:
    """SRC6: write a model as parquet, partitioned by its date grain and clustered within files.

    The REBALANCE hint on the partition columns brings a directory's rows
    together for few, large files, but adaptive execution splits a large
    directory over many tasks and merges small ones: no directory is bound
    to one task. Sorting within a task makes parquet min/max statistics
    selective. ``finish`` adds the columns that a row's others give, after the
    rebalance, so that they are not shuffled. ``dealt``: the rows of a
    directory lie in few tasks already, as the caller dealt or read them.
    Files are packed with zstd: hex keys, which differ from row to row, take
    half the room.
    """
    w = df if dealt else df.hint("rebalance", *partition_by) if partition_by else df.hint("rebalance")
    w = finish(w) if finish else w
    if cluster_by:
        w = w.sortWithinPartitions(*(partition_by or []), *cluster_by)
    writer = w.write.mode(mode).option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with freed_shuffles(df.sparkSession):
        writer.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the session's shared checkpoint folder; what is written there goes when the session ends."""
    from portflow.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/portflow-{name}-{uuid.uuid4().hex[:12]}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)  # the driver's shutdown deletes it, whatever its file system
    return f"{path}/{name}"


def through_storage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch folder of its own and read it back."""
    path = scratch_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_landing(df: DataFrame, path: str) -> None:
    """SRC5: append to the landing table; re-landed copies are resolved downstream by hash."""
    with freed_shuffles(df.sparkSession):
        df.write.mode("append").option("compression", "zstd").parquet(path)


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("_fh", F.coalesce(F.col("filter_hash"), F.lit("")))


def snapshot_upsert(target: DataFrame, source: DataFrame) -> DataFrame:
    """SRC7: MERGE on (chart_id, insight_type, data_version, filter_hash with NULL ≡ '').

    A matched target row keeps its four key columns as they are (a NULL hash
    stays NULL) and takes the 15 other columns of the source row; unmatched
    source rows are inserted as they are. Two source rows that match one
    target row are an error, as in MERGE; unmatched source rows with one key
    are all inserted. The result is a new DataFrame; write it to a new
    location (parquet has no in-place MERGE).
    """
    keys = ["chart_id", "insight_type", "data_version", "_fh"]
    others = [c for c in target.columns if c not in SNAPSHOT_KEY]
    tgt, src = _key(target), _key(source)
    per_key = src.groupBy(*keys).agg(F.count("*").alias("_n"))
    new = src.join(per_key, keys).select(*keys, "_n", *[F.col(c).alias(f"_s_{c}") for c in others])
    double = F.raise_error(F.lit("snapshot_upsert: several source rows match one target row"))
    hit = F.col("_n").isNotNull()
    merged = tgt.join(new, keys, "left").select(*[
        F.col(c) if c in SNAPSHOT_KEY
        else F.when(F.col("_n") > 1, double.cast(target.schema[c].dataType)).when(hit, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c)
        for c in target.columns
    ])
    inserted = src.join(tgt.select(*keys).distinct(), keys, "left_anti").select(*target.columns)
    return merged.unionByName(inserted)
