"""The corpus pipeline: documents to packed token sequences through five of the training-data operators.

``run(spark, sf_dir)`` applies ``STAGES`` in order. Each stage gets the session, its predecessor's documents (reread
from Parquet) and the folder of the input tables, and returns documents with all their columns; the last returns the
packed pieces. Stages:

1. toxicity: documents that the pattern grammar scores 0.5 or more go.
2. line_dedup: lines alike a line kept elsewhere go; a document that thereby loses all its lines goes.
3. near_dedup: one document of each group of near copies (five-word shingles, similarity 0.8) stays.
4. decontamination: documents that hold a benchmark passage go.
5. packing: the rest is cut and packed into windows of 1024 ids.

Null and empty texts are clean, have no lines, no near copies and no passages; they reach the packing as their end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portflow.llm import decontaminate, line_dedup, near_dedup, packing
from portflow.llm import toxicity as tox
from portflow.llm.common import free_name, ship, stored, table


MEMO = 60_000  # pieces that a worker of the last stage remembers, twice over: executors still hold what earlier stages grew


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = tox.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "toxicity")
    return tox.score(docs, model, name).where(F.col(name) < 0.5).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return line_dedup.drop_repeated_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, memo=MEMO)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

# The union-find of similar lines and documents and the tokenizer have no SQL form; tests/llm compares a run with a
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stored(stage(spark, out, sf_dir), name)
    return out
