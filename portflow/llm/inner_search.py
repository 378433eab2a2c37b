"""Exact top-k by integer inner product: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz bounds.

A component x stands for ``floor(1024 * x)``. Vectors are spread over tasks by length, longest first, and packed into
blocks of at most ``BASE`` vectors (equal ones of any number spread over blocks). A block carries the codes, lengths, the
first three quarters of the coordinates in a rotated basis, the right singular vectors of a sample, and the lengths of
what is left after a quarter, a half and three quarters of them. For two vectors, ``|q.b - partial sum| <= |rest of q|
|rest of b|``, so

1. the block of the longest vectors gives every query a floor, the score its k-th best must reach;
2. a block whose longest vector times the query's length is under the floor is skipped, with all shorter ones after it;
3. in a tile, partial sums over more and more rotated coordinates drop pairs whose upper bound is under the floor, and
   raise the floor by lower bounds; what is left is scored on the original codes, in whole numbers.

Query blocks (``QUERIES``) and base blocks meet in groups of ``GROUP`` blocks of either side: one key a pair of groups,
so tasks grow with both sides; a task holds one group of query blocks and streams base blocks. Bounds have slack for the
rounding of stored coordinates, so nothing that could be among the k best is dropped: recall is 1. The rotation only
decides how early a pair is dropped; it is fitted on at most ``SAMPLE`` vectors (those of smallest hash, of at most
``MAX_DIM`` components), all others are indexed with it, a dimension that the sample lacks with its coordinates as they are.

Edge cases: a vector that is null, holds a null or a component that is not finite (before or after scaling), and a row
without vec_id, take no part; zero vectors do, and empty ones, with score 0. Vectors are compared with those of the same
dimension only. A query is a row: only the row itself is no candidate of it, a repeated row or another row with its
vec_id is, and repeated query rows have k results each. Fewer than k candidates give fewer rows; ties go to the smaller
vec_id; a score that a long cannot hold counts as the nearest long; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy

SCALE = 1024.0
NEAREST = 10
QUERY_EVERY = 100
BASE, QUERIES, GROUP = 2048, 512, 3
SAMPLE, MAX_DIM = 2048, 4096
BLOCK_VALUES = 1 << 21  # components in a block, at most (one vector alone may have more)
PARTS = (1, 2, 3)  # quarters of the rotated coordinates after which pairs are looked at
FEW = 0.1  # share of a tile under which pairs are worked on one by one
_KINDS = ("<i2", "<i4", "<f8")  # codes are stored in the narrowest that holds them; doubles hold all of them exactly
_CODED = "row bigint, vec_id bigint, dim int, length double, codes binary, kind int"
_BLOCK = "block bigint, dim int, longest double, size int, ids binary, rows binary, codes binary, kind int, lengths binary, front binary, rests binary"
_LONG = (1 << 63) - 1


def codes_of(vectors: DataFrame) -> DataFrame:
    """Usable rows of (vec_id, embedding): row (a number of its own), vec_id, dim, length, codes, kind."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            out: list[tuple] = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                at += 1
                x = v.values
                if i is None or x is None or x.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(x.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
                    if not np.isfinite(x).all():
                        continue
                    most = np.abs(x).max(initial=0)
                    kind = 0 if most < 1 << 15 else 1 if most < 1 << 31 else 2
                    out.append((at, i, len(x), float(np.sqrt((x * x).sum())), x.astype(_KINDS[kind]).tobytes(), kind))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["row", "vec_id", "dim", "length", "codes", "kind"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(tidy(code), _CODED)


def rotations(coded: DataFrame) -> dict[int, np.ndarray]:
    """By dimension, the first right singular vectors of a sample of at most ``SAMPLE`` rows, most spread first."""
    sample: dict[int, list[np.ndarray]] = {}
    usable = coded.where(F.col("dim").between(4, MAX_DIM) & (F.col("length") > 0) & (F.col("length") < float("inf")))
    for r in usable.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).collect():
        sample.setdefault(r.dim, []).append(np.frombuffer(r.codes, _KINDS[r.kind]).astype(np.float64) / r.length)
    return {dim: np.linalg.svd(np.array(x), full_matrices=False)[2][: 3 * dim // 4].T for dim, x in sample.items()}


def cuts(dim: int) -> list[int]:
    """How many rotated coordinates are summed before each look."""
    return [dim * n // 4 for n in PARTS] if dim >= 4 else []


def packed(coded: DataFrame, size: int, basis: dict[int, np.ndarray]) -> DataFrame:
    """Blocks of at most ``size`` vectors of one dimension, of like length; a task's blocks by descending length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = TaskContext.get().partitionId() << 33

        def block() -> pa.RecordBatch:
            nonlocal at
            at += 1
            row, ids, dims, lengths, codes, kinds = zip(*held)
            dim, kind, n = dims[0], max(kinds), len(held)
            x = np.array([np.frombuffer(c, _KINDS[k]) for c, k in zip(codes, kinds)], np.float64).reshape(n, dim)
            length = np.array(lengths)
            whole = (x * x).sum(1)
            at_most, rests = cuts(dim), []
            front = np.zeros((n, 0))
            if at_most:
                v = basis.get(dim)
                front = x[:, : at_most[-1]] if v is None else x @ v
                front = np.pad(front, ((0, 0), (0, at_most[-1] - front.shape[1])))
                done = np.cumsum(front * front, 1)
                # a little more than what is left, for the rounding of sums and squares
                rests = [np.sqrt(np.maximum(whole - done[:, c - 1], 0)) + 1e-6 * length for c in at_most]
            cols = (at, dim, float(length.max()), n, np.array(ids, np.int64).tobytes(), np.array(row, np.int64).tobytes())
            cols += (x.astype(_KINDS[kind]).tobytes(), kind, length.tobytes(), front.astype(np.float32).tobytes(), np.array(rests, np.float64).tobytes())
            types = (pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, types)], names=[c.split()[0] for c in _BLOCK.split(", ")])

        with np.errstate(over="ignore", invalid="ignore"):
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns)):
                    if held and (len(held) == min(size, max(1, BLOCK_VALUES // max(1, r[2]))) or held[0][2] != r[2]):
                        yield block()
                        held = []
                    held.append(r)
            if held:
                yield block()

    order = ["dim", F.desc("length"), F.xxhash64("row")]
    return coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(pack), _BLOCK)


class Block:
    def __init__(self, r: dict):
        self.dim, self.block, self.longest = r["dim"], r["block"], r["longest"]
        self.ids, self.rows = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64)
        n = len(self.ids)
        self.x = np.frombuffer(r["codes"], _KINDS[r["kind"]]).astype(np.float64).reshape(n, self.dim)
        self.most = float(np.abs(self.x).max(initial=0))
        self.length = np.frombuffer(r["lengths"], np.float64)
        self.front = np.frombuffer(r["front"], np.float32).reshape(n, -1)
        self.rests = np.frombuffer(r["rests"], np.float64).reshape(-1, n)


def scores(q: Block, i: int, b: Block, j: np.ndarray) -> np.ndarray:
    """Inner products of query i with rows j, whole numbers held to the range of a long."""
    if q.dim * q.most * b.most < 1 << 53:  # then sums of doubles are exact
        return (b.x[j] @ q.x[i]).astype(np.int64)
    mine = [int(v) for v in q.x[i]]
    return np.array([max(-_LONG - 1, min(_LONG, sum(v * int(w) for v, w in zip(mine, b.x[n])))) for n in j.tolist()], np.int64)


def alive(q: Block, b: Block, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(query, rows of ``b``) that may be among the query's k best; ``floor`` is raised in place by lower bounds."""
    left = q.rows[:, None] != b.rows[None, :]
    both = q.length[:, None] * b.length[None, :]
    left &= ~(both * (1 + 1e-9) < floor[:, None])
    slack, done = 2e-7 * (q.dim + 4), 0
    part = np.zeros(left.shape)
    for n, cut in enumerate(cuts(q.dim)):
        if np.count_nonzero(left) <= FEW * left.size:
            break
        part += q.front[:, done:cut] @ b.front[:, done:cut].T
        rest = q.rests[n][:, None] * b.rests[n][None, :] + slack * both
        if len(b.ids) > k:
            low = np.where(left, part - rest, -np.inf)
            low = np.partition(np.where(np.isnan(low), -np.inf, low), -k, axis=1)[:, -k]
            floor[:] = np.fmax(floor, np.where(low <= -(2.0**63), -np.inf, np.minimum(low, 2.0**63)))  # scores end there
        left &= ~(part + rest < floor[:, None])
        done = cut
    for i in np.flatnonzero(left.any(1)).tolist():
        j = np.flatnonzero(left[i])
        mine, at = part[i, j], done
        for n, cut in enumerate(cuts(q.dim)):
            if cut > done and len(j):
                mine = mine + b.front[j, at:cut] @ q.front[i, at:cut]
                keep = ~(mine + q.rests[n][i] * b.rests[n][j] + slack * both[i, j] < floor[i])
                j, mine, at = j[keep], mine[keep], cut
        if len(j):
            yield i, j


def search_blocks(batches: Iterator[pa.RecordBatch], k: int, floors_only: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one key come with its query blocks first, then base blocks by descending length: the k best of each query
    in what the task saw, or, for a first look, each query block's floors."""
    key, queries = None, []

    def results() -> pa.RecordBatch:
        if floors_only:
            return pa.RecordBatch.from_arrays([pa.array([q.block for q, *_ in queries], pa.int64()), pa.array([f.tobytes() for _, f, _ in queries], pa.binary()), pa.array([float(f.min()) for _, f, _ in queries], pa.float64())], names=["block", "floors", "least"])
        rows = [(row, i, v, s) for q, _, best in queries for row, i, (ids, ss) in zip(q.rows.tolist(), q.ids.tolist(), best) for v, s in zip(ids.tolist(), ss.tolist())]
        cols = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row", "query_id", "vec_id", "score"])

    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        for batch in batches:
            for n in range(len(batch)):
                r = {name: batch.column(c)[n].as_py() for c, name in enumerate(batch.schema.names)}
                if (r["dim"], r["q_group"], r["b_group"]) != key:
                    if queries:
                        yield results()
                    key, queries = (r["dim"], r["q_group"], r["b_group"]), []
                block = Block(r)
                if not r["base"]:
                    floor = np.full(len(block.ids), -np.inf) if r["floors"] is None else np.frombuffer(r["floors"], np.float64).copy()
                    queries.append((block, floor, [nothing] * len(block.ids)))
                    continue
                for q, floor, best in queries:
                    if q.longest * block.longest * (1 + 1e-9) < floor.min():
                        continue
                    for i, j in alive(q, block, k, floor):
                        ids, s = np.concatenate([best[i][0], block.ids[j]]), np.concatenate([best[i][1], scores(q, i, block, j)])
                        keep = np.lexsort((ids, ~s))[:k] if len(s) > k else np.arange(len(s))
                        best[i] = ids[keep], s[keep]
                        if len(keep) == k:
                            least = float(s[keep].min())
                            floor[i] = max(floor[i], least if least > -(2.0**63) else -np.inf)
        if queries:
            yield results()


def top_inner_products(vectors: DataFrame, is_query: Column | str, k: int = NEAREST) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vec_id, embedding) with the largest inner product for each row for which
    ``is_query``, a condition on vec_id, holds: query_id, rank (from 1), vec_id, score."""
    coded = stored(codes_of(vectors), "codes")
    basis = rotations(coded)
    base = stored(packed(coded, BASE, basis), "base-blocks")
    asked = stored(packed(coded.where(is_query), QUERIES, basis), "query-blocks")
    groups = lambda t, c: t.groupBy("dim").agg(F.ceil(F.count("*") / GROUP).cast("long").alias(c))
    parts = stored(groups(base, "b_groups").join(groups(asked, "q_groups"), "dim"), "block-groups")  # a row a dimension
    group = lambda n: F.pmod(F.xxhash64("block"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    fields = [c.split()[0] for c in _BLOCK.split(", ")]

    def met(q: DataFrame, b: DataFrame, out: str, floors_only: bool) -> DataFrame:
        rows = q.select("q_group", "b_group", F.lit(False).alias("base"), "floors", *fields)
        rows = rows.unionByName(b.select("q_group", "b_group", F.lit(True).alias("base"), F.lit(None).cast("binary").alias("floors"), *fields))
        rows = rows.repartition("dim", "q_group", "b_group").sortWithinPartitions("dim", "q_group", "b_group", "base", F.desc("longest"))
        return rows.mapInArrow(tidy(lambda batches: search_blocks(batches, k, floors_only)), out)

    asked = asked.join(parts, "dim").withColumn("q_group", group("q_groups"))
    longest = base.select("dim", "block", "longest").groupBy("dim").agg(F.max_by("block", "longest").alias("block"))  # a block a dimension
    first = base.join(longest, ["dim", "block"], "left_semi").join(parts, "dim").withColumn("b_group", F.lit(0).cast("long")).withColumn("q_group", each("q_groups"))
    alone = asked.withColumn("b_group", F.lit(0).cast("long")).withColumn("floors", F.lit(None).cast("binary"))
    floors = stored(met(alone, first, "block bigint, floors binary, least double", True), "floors")

    least = asked.select("dim", "block", "longest", "q_group").join(floors.select("block", "least"), "block")
    least = least.groupBy("dim", "q_group").agg(F.max("longest").alias("q_longest"), F.min("least").alias("least"))
    asked = asked.join(floors.drop("least"), "block").withColumn("b_group", each("b_groups"))
    rest = base.join(parts, "dim").withColumn("b_group", group("b_groups")).withColumn("q_group", each("q_groups")).join(least, ["dim", "q_group"])
    rest = rest.where(~(F.col("longest") * F.col("q_longest") * (1 + 1e-9) < F.col("least")))  # too short for every query of the group
    found = met(asked, rest, "row bigint, query_id bigint, vec_id bigint, score bigint", False)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
