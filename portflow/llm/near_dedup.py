"""Near-duplicate documents: MinHash banding with sequential Bayesian verification (after Satuluri and Parthasarathy).

1. One pass makes each document's set of word shingles and its digest; documents with equal sets become one class, so
   any number of copies costs one row a copy and no pair.
2. Classes that share a band of MinHash values are candidates (``BANDS`` bands of ``ROWS`` values: a pair at similarity
   0.8 is missed with probability (1 - 0.8^5)^20 = 0.0004, a pair at 0.9 with 1e-8).
3. Candidates compare fresh signatures, ``BATCH`` values at a time. After n values with m equal ones the posterior of
   the similarity (uniform prior) is Beta(m + 1, n - m + 1); a pair is pruned as soon as the probability of reaching
   the threshold falls below ``MISS``. The least m that survives at each n is a small table.
4. Survivors are verified on their full sets. Sets hold 64-bit hashes of shingles.
5. Distributed union-find gives the components.

Edge cases: null texts, empty texts and texts of white space only have an empty set, are linked with nothing and are
their own component; a text with fewer words than a shingle has its whole sequence as one shingle; rows that repeat a
doc_id are documents of their own in the linking, and share the id in the result; a null doc_id never names a
component: its row gets the smallest id it reaches, or null, and counts as kept if that is null; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH, MISS, VALUES, Comparison, MinHasher, band_keys, banded_components, digest, least_matches, semi_by, shingle_set, small_enough, stored, text_slices, word_hashes, tidy

THRESHOLD = 80  # per cent
BANDS, ROWS = 20, 5

_SETS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.list_(pa.int64()))])
_SETS_SQL = "row bigint, doc_id bigint, h1 bigint, h2 bigint, n_shingles bigint, d1 bigint, d2 bigint, keys array<bigint>"
_PROFILE = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("signature", pa.binary()), ("shingles", pa.binary())])
_PROFILE_SQL = "d1 bigint, d2 bigint, signature binary, shingles binary"


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, data, off in text_slices(column):
        words, at = word_hashes(data, off)
        for i in range(len(off) - 1):
            yield shingle_set(words[at[i] : at[i + 1]], k)


def prune(a: np.ndarray, b: np.ndarray, need: dict[int, int]) -> np.ndarray:
    """Which pairs of signatures (row by row) survive all batches; a pruned pair is not compared further."""
    alive = np.arange(len(a))
    equal = np.zeros(len(a), np.int64)
    last = 0
    for n, m in need.items():
        equal[alive] += (a[alive, last:n] == b[alive, last:n]).sum(1)
        alive = alive[equal[alive] >= m]
        last = n
    return alive


def _text_hashes(text: Column) -> tuple[Column, Column]:
    """128 bits of a text."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _linked(docs: DataFrame, k: int, threshold: int, bands: int, rows: int, values: int, batch: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """(a row a document: doc_id, h1, h2 of its text, n_shingles, d1, d2 of its set; a row a class of equal sets: d1, d2,
    least_id, n_class, root), both stored."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, row = MinHasher(bands * rows, 11), TaskContext.get().partitionId() << 33
        for b in batches:
            out = []
            for i, x, y, s in zip(*(b.column(c).to_pylist() for c in (0, 2, 3)), _sets(b.column(1), k)):
                d = digest(s)
                keys = band_keys(hashes(s), bands, rows)[0] if len(s) else None
                out.append((row, i, x, y, len(s), *d, keys))
                row += 1
            cols = list(zip(*out)) if out else [[]] * len(_SETS)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SETS)], schema=_SETS)

    text = docs.select("doc_id", "text")
    sets = stored(docs.select("doc_id", "text", *_text_hashes(docs["text"])).mapInArrow(tidy(sketch), _SETS_SQL), "shingles")
    full = sets.where("n_shingles > 0")
    own = full.groupBy("d1", "d2").agg(F.min("row").alias("cid"), F.min("doc_id").alias("least_id"), F.count("*").alias("n_class"))
    classes = stored(own, "classes")
    items = full.select("row", "keys").join(classes.select(F.col("cid").alias("row")), "row").select(F.col("row").alias("cid"), "keys")

    def prepare(cids: DataFrame) -> Comparison:
        picked = stored(cids.join(full.select(F.col("row").alias("cid"), "doc_id", "d1", "d2"), "cid"), "candidates")

        def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = MinHasher(values, 12)
            for b in batches:
                held, size = [], 0
                for s in _sets(b.column(0), k):
                    if len(s):
                        held.append((*digest(s), hashes(s).tobytes(), s.tobytes()))
                        size += s.nbytes
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _PROFILE)], schema=_PROFILE)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _PROFILE)], schema=_PROFILE)

        ids = picked.select("cid", "d1", "d2")
        ids = F.broadcast(ids) if small_enough(ids) else ids
        found = semi_by(text, picked, "doc_id").select("text").mapInArrow(tidy(profile), _PROFILE_SQL).join(ids, ["d1", "d2"])
        profiles = stored(found.dropDuplicates(["cid"]).select("cid", "signature", "shingles"), "profiles")
        need = least_matches(threshold / 100, values, batch, miss)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, values) for c in b.columns[2:])
                yield pa.RecordBatch.from_arrays([c.take(pa.array(prune(x, y, need))) for c in b.columns[:2]], names=["a", "b"])

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                linked = []
                for x, y in zip(b.column(2), b.column(3)):
                    s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    linked.append(100 * both >= threshold * (len(s) + len(t) - both))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(linked, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

        def with_both(pairs: DataFrame, column: str) -> DataFrame:
            x, y = (profiles.select(F.col("cid").alias(c), F.col(column).alias(f"{column}_{c}")) for c in "ab")
            return pairs.join(y, "b").join(x, "a").select("a", "b", f"{column}_a", f"{column}_b")

        def verify(pairs: DataFrame) -> DataFrame:
            alive = stored(with_both(pairs, "signature").mapInArrow(tidy(compare), "a bigint, b bigint"), "survivors")
            return with_both(alive, "shingles").mapInArrow(tidy(confirm), "a bigint, b bigint")

        payload = profiles.select("cid", F.col("shingles").alias("payload"))
        return Comparison(verify, payload, lambda sets: [np.frombuffer(s, np.uint64) for s in sets], threshold)

    roots = banded_components(items, prepare)
    reached = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("d1", "d2", "least_id", "n_class", F.coalesce("root", "cid").alias("root"))
    return sets, stored(reached, "reached")


def near_duplicates(docs: DataFrame, k: int = 2, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, values: int = VALUES, batch: int = BATCH, miss: float = MISS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, n_class (rows with an equal set).

    Documents are linked if 100 * intersection >= threshold * union of their sets of ``k``-word shingles.
    """
    sets, reached = _linked(docs, k, threshold, bands, rows, values, batch, miss)
    full = sets.where("n_shingles > 0")
    least = reached.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = reached.join(least, "root").select("d1", "d2", "component_id", "n_class")
    linked = full.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id", "n_class")
    alone = sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_class"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "n_class")


def drop_near_duplicates(docs: DataFrame, k: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each component: of its rows with the smallest id (null only if all are) the one with the
    smallest text hash. Rows go by their id and text, so a row never takes another text of its id along; of fully
    repeated rows (same id, same text) one stays. All columns stay."""
    sets, reached = _linked(docs, k, threshold, BANDS, ROWS, VALUES, BATCH, MISS)
    full = sets.where("n_shingles > 0").select("doc_id", "h1", "h2", "d1", "d2")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    first = full.groupBy("d1", "d2").agg(F.min(place).alias("first"))
    classes = reached.select("d1", "d2", "n_class", "root").join(first, ["d1", "d2"])
    keep = classes.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n_class").alias("n")).where("n > 1").select("root", "keep")
    named = stored(classes.select("d1", "d2", "root").join(keep, "root").select("d1", "d2", "keep"), "keepers")
    alike = full.join(named, ["d1", "d2"]).withColumn("kept", place.eqNullSafe(F.col("keep")))
    alike = alike.groupBy(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "kept").agg(F.count("*").alias("n"))
    alike = stored(alike.where("not kept or n > 1"), "alike")
    repeated = alike.where("kept").select("_id", "_h1", "_h2")

    def among(keys: DataFrame, how: str) -> DataFrame:
        keys = F.broadcast(keys) if small_enough(keys) else keys
        h1, h2 = _text_hashes(docs["text"])
        return docs.join(keys, docs["doc_id"].eqNullSafe(keys["_id"]) & (h1 == keys["_h1"]) & (h2 == keys["_h2"]), how)

    out = among(alike.select("_id", "_h1", "_h2"), "left_anti")
    return out if repeated.isEmpty() else out.unionByName(among(repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
