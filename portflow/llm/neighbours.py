"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, survivors recomputed, heaps merged.

Vectors are packed into blocks: float32 originals, int8 codes with one scale a vector, and the norms of the coded
vector and of what coding lost. A tile is the product of a query block's and a base block's codes (whole numbers, exact
in the matrix product); by Cauchy-Schwarz the true inner product differs from it by at most
``|q^| |e| + |f| |x^| + |f| |e|`` (hats: coded vectors, e and f: losses). In each tile the k-th largest lower bound of a
query is a floor; only pairs whose upper bound reaches it, and the floor of tiles before, are recomputed in double
precision. A heap of k pairs a query is merged over a task's tiles, and Spark keeps the k best of all tasks.

No pair is dropped that could be among the k nearest: the result is exact, recall against brute force is 1. Work is
queries x rows / tile, shared evenly: base blocks have at most ``BASE`` vectors whatever their values, so equal
vectors of any number spread over blocks. Query blocks are sent once to each group of about ``GROUP`` base blocks.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without a vec_id, take
no part; rows with the query's own vec_id are no candidates of it; vectors are compared with those of the same
dimension only; fewer than k candidates give fewer rows; ties go to the smaller vec_id; other columns are ignored.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy

BASE, QUERIES, GROUP = 4096, 512, 16
NEAREST = 20
QUERY_EVERY = 20

_BLOCK = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
_BLOCK_SQL = "block bigint, dim int, ids binary, vectors binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, norms of the coded vectors, norms of the losses), a vector a row, in double precision."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None])
    coded = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.linalg.norm(coded, axis=1), np.linalg.norm(x - coded, axis=1)


class Block:
    def __init__(self, ids: bytes, vectors: bytes, dim: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.x = np.frombuffer(vectors, np.float32).reshape(-1, dim).astype(np.float64)
        codes, self.scale, self.norm, self.loss = quantise(self.x)
        self.codes = codes.astype(np.float32 if dim < 1000 else np.float64)  # sums of products of codes stay exact


def tile(q: Block, b: Block, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, scores, ids) of the pairs of a tile that may be among the k nearest; ``floor``: what a pair must
    reach, by query (kept up to date)."""
    near = (q.codes @ b.codes.T).astype(np.float64) * q.scale[:, None] * b.scale[None, :]
    slack = q.norm[:, None] * b.loss[None, :] + q.loss[:, None] * (b.norm + b.loss)[None, :]
    slack += 1e-9 * (q.norm + q.loss)[:, None] * (b.norm + b.loss)[None, :]  # rounding of the sums themselves
    own = q.ids[:, None] == b.ids[None, :]
    low = near - slack
    low[own] = -np.inf
    if len(b.ids) > k:
        floor[:] = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
    alive = (near + slack >= floor[:, None]) & ~own
    for i in np.flatnonzero(alive.any(1)).tolist():
        j = np.flatnonzero(alive[i])
        s = np.einsum("ij,j->i", b.x[j], q.x[i])
        if len(j) > k:
            keep = s >= np.partition(s, -k)[-k]
            j, s = j[keep], s[keep]
        yield i, s, b.ids[j]


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Usable vectors (vec_id, embedding) in blocks of at most ``size`` of one dimension."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        at = TaskContext.get().partitionId() << 33

        def row(dim: int):
            nonlocal at
            at += 1
            ids, xs = zip(*held.pop(dim))
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([b"".join(xs)])], schema=_BLOCK)

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                x = v.values
                if i is None or x is None or not len(x) or x.null_count:
                    continue
                x = x.to_numpy(zero_copy_only=False).astype(np.float32)
                if not np.isfinite(x).all() or not x.any():
                    continue
                held.setdefault(len(x), []).append((i, x.tobytes()))
                if len(held[len(x)]) == size:
                    yield row(len(x))
        for dim in list(held):
            yield row(dim)

    return vectors.select("vec_id", F.col("embedding").cast("array<float>")).mapInArrow(tidy(pack), _BLOCK_SQL)


def nearest(queries: DataFrame, base: DataFrame, k: int = NEAREST) -> DataFrame:
    """The ``k`` rows of ``base`` with the largest inner product for each row of ``queries`` (vec_id, embedding):
    query_id, rank (from 1), vec_id, score."""
    b = stored(blocks(base, BASE), "base-blocks")
    parts = stored(b.groupBy("dim").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("parts")), "parts")  # a row a dimension
    b = b.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")))
    q = stored(blocks(queries, QUERIES), "query-blocks").join(parts, "dim")
    q = q.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    pairs = q.join(b, ["dim", "part"]).select("q_block", "dim", "q_ids", "q_vectors", "ids", "vectors")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, query, heaps, floor = None, None, [], None

        def flush():
            rows = [(i, v, s) for i, h in zip(query.ids.tolist(), heaps) for s, v in h]
            cols = list(zip(*rows)) if rows else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([-v for v in cols[1]], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for n in range(len(batch)):
                x = {name: batch.column(c)[n].as_py() for c, name in enumerate(batch.schema.names)}
                if now != x["q_block"]:
                    if query is not None:
                        yield flush()
                    now, query = x["q_block"], Block(x["q_ids"], x["q_vectors"], x["dim"])
                    heaps, floor = [[] for _ in query.ids], np.full(len(query.ids), -np.inf)
                for i, scores, ids in tile(query, Block(x["ids"], x["vectors"], x["dim"]), k, floor):
                    h = heaps[i]
                    for pair in zip(scores.tolist(), (-ids).tolist()):  # larger score first, then smaller id
                        if len(h) < k:
                            heapq.heappush(h, pair)
                        elif pair > h[0]:
                            heapq.heapreplace(h, pair)
        if query is not None:
            yield flush()

    spread = pairs.mapInArrow(tidy(products), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return spread.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
