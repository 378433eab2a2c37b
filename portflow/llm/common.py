"""Shared parts of the training-data operators: stored tables, hashing of bytes, words and shingles, banded
candidates and distributed union-find.

Everything here is either DataFrame code or numpy inside tasks on one Arrow batch at a time (batches are cut to a
few MB, so memory does not grow with the table). Intermediate tables go to the folder that ``spark.checkpoint.dir``
names; a lost executor costs the running stage only.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portflow.session import ensure_checkpoint_dir

SLICE_BYTES = 1 << 19
# A side is broadcast only if it has at most this many narrow rows (a key of 8 to 16 bytes each); beyond it the same join shuffles.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


ARROW_BATCH = "4m"  # bytes that go to a Python worker at once; texts may be long


def ship(spark: SparkSession) -> None:
    """Prepare a session: send this package to the executors (once), as ``--py-files`` would, and keep Arrow batches
    small, so that the memory of workers is bounded by bytes and not by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    mark = "portflow.shipped"
    if spark.conf.get(mark, "") == spark.sparkContext.applicationId:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="portflow-ship-"), "portflow_code.zip")  # read by the driver's file server
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in sorted(os.walk(top)):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    spark.conf.set(mark, spark.sparkContext.applicationId)


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the lineage, survives lost executors.

    Hashes do not compress: tables of hashes are written without trying.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores added until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` (narrow, stored) has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def semi_by(df: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """Rows of ``df`` whose ``col`` is among ``keys[col]`` (null equals null); broadcasts the keys only when few."""
    k = keys.select(F.col(col).alias("_k")).distinct()
    k = F.broadcast(k) if small_enough(k) else k
    return df.join(k, df[col].eqNullSafe(k["_k"]), "left_semi")


def tidy(fn: Callable, encodes: bool = False) -> Callable:
    """``fn`` over batches; then gives the task's memory back to the system, as workers live on for other tasks. A worker
    whose task doesn't encode (``encodes``) also lets go of the tokenizer and its pieces."""

    def run(batches):
        if not encodes:
            _forget_tokenizers()
        yield from fn(batches)
        _release()

    return run


def arrow_column(fn: Callable, kind: str, columns: int = 1) -> Callable:
    """A column of type ``kind`` by ``fn``, ``tidy`` over the Arrow arrays of one or more columns: no pandas in the
    workers, no second copy of the texts, and what a task grew goes back to the system when it ends."""
    run = tidy(fn)
    run.__annotations__ = {"batches": Iterator[pa.Array if columns == 1 else tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def _forget_tokenizers() -> None:
    tokens = sys.modules.get(f"{__package__}.tokens")
    if tokens is not None and tokens._encoders:
        tokens._encoders.clear()
        _release()


def _release() -> None:
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:  # glibc alone has it
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim.argtypes = [ctypes.c_size_t]
except (OSError, AttributeError):
    _libc = None


# --- bytes, words and shingles of one Arrow batch -------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240607))
_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_BYTE = _rng.integers(1, 1 << 64, 256, dtype=np.uint64)
_WORD_BYTE = _BYTE.copy()
_WORD_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        have = _pow[base] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with well spread bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of consecutive rows of a string column, about ``most`` bytes each; null is empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = arr.fill_null("").cast(pa.large_string())
    if len(arr) == 0:
        return
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-independent 64-bit hashes of [start, end) from ``prefix`` (prefix[i]: hash of the first i symbols)."""
    n = len(prefix)
    h = (prefix[end] - prefix[start]) * powers(_PINV, n)[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of 64-bit symbols modulo 2**64."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(_P, len(symbols)), out=out[1:])
    return out


def word_hashes(data: np.ndarray, off: np.ndarray, inside: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words and, by row, where each row's words begin.

    ``inside``: which bytes are parts of words; by default all but white space (0x20, 0x09 to 0x0D).
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    word = inside[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cut = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    first[cut] = word[cut]
    last[cut - 1] = word[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = span_hashes(prefix_hash(_WORD_BYTE[data]), start, end)
    return h, np.searchsorted(start, off)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of a row's k-word shingles; with fewer words the whole sequence is one; no words: none."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.full(n, min(k, len(words)), np.uint64)
    for j in range(min(k, len(words))):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return np.unique(h)


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets have in common."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int(np.count_nonzero(y.take(y.searchsorted(x), mode="clip") == x))


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed longs."""
    b = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(b[:8], "little", signed=True), int.from_bytes(b[8:], "little", signed=True)


class MinHasher:
    """``n`` independent minima of a hashed set (32 bits each)."""

    def __init__(self, n: int, seed: int):
        g = np.random.Generator(np.random.PCG64(seed))
        self.a = g.integers(1, 1 << 64, n, dtype=np.uint64) | np.uint64(1)
        self.b = g.integers(0, 1 << 64, n, dtype=np.uint64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), _MASK, np.uint64)
        for i in range(0, len(values), 512):
            np.minimum(out, (values[i : i + 512, None] * self.a + self.b).min(0), out=out)
        return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray, bands: int, rows: int, salt: int = 0) -> np.ndarray:
    """One 64-bit key for each band of signatures (rows x hashes, or one signature)."""
    sig = np.atleast_2d(signature)[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1 + salt, bands + 1 + salt, dtype=np.uint64), sig.shape[:2])
    for j in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, j])
    return h.astype(np.int64)


# --- distributed union-find -----------------------------------------------------------------------------------------


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of longs); root is the smallest node reachable.

    Alternating large-star and small-star steps: each is two aggregations with map-side combine and equi-joins whose
    skewed keys AQE splits, so a hub with any number of neighbours is never gathered in one task. The edge table is
    stored after every round; rounds end when every node hangs on one root that hangs on none, and their number grows
    with the logarithm of the longest path. Nodes without an edge are not returned; no edges give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(moved.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "stars")
        # a node counts once as a child; a root must not be one
        seen = e.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
            e.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
        )
        odd = seen.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 or (child > 0 and parent > 0)")
        if odd.isEmpty():
            break
    roots = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _relabelled(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """Labels (node, root) with the links ``found`` (a, b) added: only the roots that they join are worked on."""
    if labels is None:
        return stored(connected(found), "labels")
    x, y = (labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    lifted = found.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    top = stored(connected(stored(lifted, "lifted")), "roots")
    new = labels.join(top.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return stored(new.unionByName(top.join(labels.select("node"), "node", "left_anti")), "labels")


def least_matches(threshold: float, values: int, batch: int, miss: float) -> dict[int, int]:
    """For n = batch, 2 batch, ...: the least number of equal values at which P(similarity >= threshold) >= miss.

    For a Beta(m + 1, n - m + 1) posterior, that probability is the chance of at most m successes in n + 1 draws.
    """
    out = {}
    for n in range(batch, values + 1, batch):
        below, m = 0.0, 0
        for m in range(n + 1):
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
        out[n] = m
    return out


VALUES, BATCH, MISS = 256, 32, 0.001
BLOCK = 512  # members of a bucket that are compared in one task, on either side
TOGETHER = 2 << 20  # bytes of small blocks that are worked on together


def linked_in_block(comps: list[int], sides: list[int], sets: list[np.ndarray], threshold: int, need: dict[int, int], hashes: MinHasher) -> list[tuple[int, int]]:
    """Links (places) that join what is not joined yet: pairs of different components (and different sides, if the
    block has two) whose sizes allow the threshold, pruned by signature batches, likeliest first, verified exactly."""
    comp, side, size = np.array(comps), np.array(sides), np.array([len(s) for s in sets])
    i, j = np.triu_indices(len(sets), 1)
    if (side != side[0]).any():
        k = side[i] != side[j]
        i, j = i[k], j[k]
    k = (comp[i] != comp[j]) & (100 * np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]))
    i, j = i[k], j[k]
    equal, last = np.zeros(len(i), np.int64), 0
    few = len(i) <= 8 * len(sets)  # then signatures cost more than they save
    signature = None if few else np.array([hashes(s) for s in sets])
    for n, m in () if few else need.items():
        for a in range(0, len(i), 65_536):
            b = slice(a, a + 65_536)
            equal[b] += (signature[i[b], last:n] == signature[j[b], last:n]).sum(1)
        k = equal >= m
        i, j, equal, last = i[k], j[k], equal[k], n
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    out = []
    for x, y in zip(*(c[np.argsort(-equal, kind="stable")].tolist() for c in (i, j))):
        a, b = find(comps[x]), find(comps[y])
        if a != b:
            both = common(sets[x], sets[y])
            if 100 * both >= threshold * (len(sets[x]) + len(sets[y]) - both):
                root[max(a, b)] = min(a, b)
                out.append((x, y))
    return out


@dataclass
class Comparison:
    """How candidates are compared: ``verify`` takes pairs (a, b) and returns the linked ones; ``payload`` (cid,
    payload) is what a task needs of an item, ``sets`` makes the sorted hashed sets of a list of payloads; ``miss`` is the
    posterior probability of reaching the threshold under which a pair is pruned."""

    verify: Callable[[DataFrame], DataFrame]
    payload: DataFrame
    sets: Callable[[list[bytes]], list[np.ndarray]]
    threshold: int
    miss: float = MISS


def banded_components(items: DataFrame, prepare: Callable[[DataFrame], Comparison]) -> DataFrame:
    """(node, root) of linked items among items that share a band key; whole, without all pairs.

    ``items``: cid (long), keys (array of long). ``prepare`` gets the cids of all items that share a key with another.
    In every bucket, first its smallest cid is compared with the others, which finds nearly all links: a bucket of
    copies costs one pair a member. Buckets whose members are then not all connected are compared in blocks of at most
    ``BLOCK`` members, a larger bucket in pairs of blocks, each its own task's work: there, only pairs that are not
    connected yet are looked at, by signature batches pruned at the comparison's miss probability, then exactly; only
    links that join something leave the task. No link between items that share a bucket is dropped but for that.
    """
    flat = items.select("cid", F.explode("keys").alias("key"))
    buckets = flat.groupBy("key").agg(F.count("*").alias("size"), F.min("cid").alias("hub")).where("size > 1")
    rest = stored(flat.join(buckets, "key").where("cid <> hub").select("key", "cid", "hub"), "buckets")
    hubs = rest.select(F.col("hub").alias("cid")).distinct()
    comparison = prepare(rest.select("cid").unionByName(hubs).distinct())
    pairs = stored(rest.select(F.col("hub").alias("a"), F.col("cid").alias("b")).distinct(), "pairs")
    labels = _relabelled(None, stored(comparison.verify(pairs).select("a", "b"), "links"))

    left = rest.select("key", "cid").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    left = stored(left.select("key", "cid", F.coalesce("root", "cid").alias("comp")), "members")
    who = [F.bit_xor(F.xxhash64("cid", F.lit(i))).alias(f"who{i}") for i in (0, 1)]
    live = left.groupBy("key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *who).where("lo <> hi")
    live = live.groupBy("size", "lo", "hi", "who0", "who1").agg(F.min("key").alias("key"))  # buckets of the same members are one
    live = live.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    split = left.join(live, "key").withColumn("side", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    split = split.select("key", "cid", "comp", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    split = split.select("key", "cid", "comp", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    need = least_matches(comparison.threshold / 100, VALUES, BATCH, comparison.miss)
    sets, threshold = comparison.sets, comparison.threshold

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, group, blocks, size = MinHasher(VALUES, 13), None, [], 0

        def links() -> pa.RecordBatch:
            one = {cid: payload for block in blocks for cid, _, _, payload in block}  # an item of several blocks is cut once
            made = dict(zip(one, sets(list(one.values()))))
            out = []
            for block in blocks:
                if len(block) > 1:
                    cids, comps, sides, _ = zip(*block)
                    found = linked_in_block(comps, sides, [made[c] for c in cids], threshold, need, hashes)
                    out += [(cids[x], cids[y]) for x, y in found]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            for key, lo, hi, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (key, lo, hi) != group:
                    if size > TOGETHER:
                        yield links()
                        blocks, size = [], 0
                    group = key, lo, hi
                    blocks.append([])
                blocks[-1].append(row)
                size += 200 + len(row[-1])
        if blocks:
            yield links()

    rows = split.join(comparison.payload, "cid").select("key", "lo", "hi", "cid", "comp", "side", "payload")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return _relabelled(labels, stored(rows.mapInArrow(tidy(resolve), "a bigint, b bigint"), "links"))
