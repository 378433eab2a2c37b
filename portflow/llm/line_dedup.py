"""Fuzzy line dedup: character-shingle MinHash, high-recall banding, exact Jaccard, union-find, one line a component.

A line is what stands between line feeds, without white space at its ends; lines without other characters are no
lines. Equal lines become one item first, so any number of copies costs one row a copy. Items that share a band are
candidates, pairs are verified on their full shingle sets, and distributed union-find gives the components; the line
with the smallest (doc_id, line number) of a component is kept.

Signatures: lines of up to ``SHORT`` distinct shingles have ``BANDS * ROWS`` independent minima, lines from 0.8 *
``SHORT`` on one permutation split into as many bins (empty bins borrow from the next one), which costs one hash a
shingle whatever the number of values. Both kinds of keys are made between these numbers, so two lines similar enough
always share a kind, however often they repeat themselves. A pair at similarity 0.8 is missed with probability (1 - 0.8^4)^10 = 0.005, at 0.9 with 2e-5.

Everything up to the keys is numpy on whole slices of a batch (UTF-8 bytes, character starts, prefix hashes): there is
no loop over lines or characters. Sets hold 64-bit hashes of shingles.

Edge cases: null and empty texts have no lines; a line with fewer characters than a shingle has itself as its only
shingle; lines of documents without a doc_id come after all others as keepers, in the order of their copies' line
numbers; texts that share a doc_id, or lack one, are told apart by their hash; of rows with equal doc_id and text
``drop_repeated_lines`` takes one (``fuzzy_lines`` marks the line of each of them as kept); an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import Comparison, arrow_column, band_keys, banded_components, common, free_name, mix, powers, prefix_hash, semi_by, small_enough, span_hashes, stored, text_slices, tidy

SHINGLE = 8
THRESHOLD = 80  # per cent
BANDS, ROWS = 10, 4
SHORT = 160
BLOCK = 1 << 14  # shingles whose minima are taken together

_OTHER_BYTE = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 64, 256, dtype=np.uint64)
_EMPTY = np.uint64(0xFFFFFFFF)


def _trimmed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without white space at their ends; a span of nothing else ends where it starts."""
    a, b = start.copy(), end.copy()
    for _ in range(8):  # nearly all lines have little of it
        i = np.flatnonzero((a < b) & C._SPACE[data[np.minimum(a, len(data) - 1)]])
        j = np.flatnonzero((a < b) & C._SPACE[data[b - 1]])
        if not len(i) and not len(j):
            return a, b
        a[i] += 1
        b[j] = np.maximum(b[j] - 1, a[j])
    solid = np.flatnonzero(~C._SPACE[data])
    i, j = np.searchsorted(solid, start), np.searchsorted(solid, end)
    a, b = start.copy(), start.copy()
    some = j > i
    a[some], b[some] = solid[i[some]], solid[j[some] - 1] + 1
    return a, b


class Slice:
    """The lines of some rows: row, line number, byte and character spans, digests."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = data
        feed = data == 10
        starts = np.unique(np.concatenate([off[:-1], np.flatnonzero(feed) + 1]))
        starts = starts[starts < len(data)]
        ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
        self.row = np.searchsorted(off, starts, "right") - 1
        first = np.searchsorted(starts, off[:-1])
        self.number = np.arange(len(starts)) - first[self.row]
        a, b = _trimmed(data, starts, ends)
        some = b > a
        self.row, self.number = self.row[some], self.number[some]
        self.start, self.end = a[some], b[some]
        self.prefix = prefix_hash(C._BYTE[data])
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        self.chars = np.concatenate([chars, [len(data)]])
        self.all: tuple[int, np.ndarray] | None = None
        self.c0 = np.searchsorted(chars, self.start)
        self.c1 = np.searchsorted(chars, self.end)
        # a line may end inside a character only in broken UTF-8, which Spark strings do not hold

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each line."""
        other = prefix_hash(_OTHER_BYTE[self.data])
        return span_hashes(self.prefix, self.start, self.end).view(np.int64), span_hashes(other, self.start, self.end).view(np.int64)

    def shingles(self, k: int, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, where each of ``lines`` begins among them, and the end)."""
        if self.all is None or self.all[0] != k:  # of the whole slice at once; those across line ends are never taken
            a, b = self.chars[:-k], self.chars[k:]
            self.all = k, mix((self.prefix[b] - self.prefix[a]) * powers(C._PINV, len(self.prefix))[a])
        n = np.maximum(1, self.c1[lines] - self.c0[lines] - k + 1)
        at = np.concatenate([[0], np.cumsum(n)])
        i = np.arange(at[-1]) + np.repeat(self.c0[lines] - at[:-1], n)
        short = self.c1[lines] - self.c0[lines] < k
        if not short.any():
            return self.all[1][i], at
        h = self.all[1][np.minimum(i, len(self.all[1]) - 1)] if len(self.all[1]) else np.zeros(len(i), np.uint64)
        h[at[:-1][short]] = span_hashes(self.prefix, self.start[lines[short]], self.end[lines[short]])
        return h, at


def _minima(h: np.ndarray, at: np.ndarray, values: int) -> np.ndarray:
    """Independent minima: lines x values."""
    g = np.random.Generator(np.random.PCG64(31))
    a = g.integers(1, 1 << 64, values, dtype=np.uint64) | np.uint64(1)
    b = g.integers(0, 1 << 64, values, dtype=np.uint64)
    out = np.empty((len(at) - 1, values), np.uint32)
    made = np.empty(min(len(h), 2 * BLOCK), np.uint64)
    first = 0
    while first < len(at) - 1:  # lines of about BLOCK shingles, so that what is made of them stays in the processor's cache
        last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1)
        x, starts = h[at[first] : at[last]], at[first:last] - at[first]
        if len(x) > len(made):  # a line longer than that
            made = np.empty(len(x), np.uint64)
        t = made[: len(x)]
        for j in range(values):
            np.multiply(x, a[j], out=t)
            np.add(t, b[j], out=t)
            out[first:last, j] = np.minimum.reduceat(t, starts) >> np.uint64(32)  # the least number has the least upper half
        first = last
    return out


def _binned(h: np.ndarray, at: np.ndarray, values: int) -> np.ndarray:
    """One permutation in ``values`` bins; an empty bin borrows from the next that is not, marked by the distance."""
    return _binned_counted(h, at, values)[0]


def _binned_counted(h: np.ndarray, at: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures as of ``_binned``, each line's number of distinct shingles by bin and the lower 32 bits)."""
    n = len(at) - 1
    slot = np.repeat(np.arange(n, dtype=np.uint64) * np.uint64(values), np.diff(at))
    made = h >> np.uint64(32)
    made *= np.uint64(values)
    made >>= np.uint64(32)
    slot += made
    slot <<= np.uint64(32)
    key = np.bitwise_or(slot, np.bitwise_and(h, _EMPTY, out=made), out=slot)
    key.sort()  # by line: each keeps its place among the lines
    distinct = np.add.reduceat(np.concatenate([[True], key[1:] != key[:-1]]), at[:-1], dtype=np.int64)
    slot = key >> np.uint64(32)
    first = np.concatenate([[True], slot[1:] != slot[:-1]])
    out = np.full(n * values, _EMPTY + np.uint64(1), np.uint64)
    out[slot[first].astype(np.int64)] = key[first] & _EMPTY
    out = out.reshape(n, values)
    empty = out > _EMPTY
    from_here = out[:, 0].copy()
    away = np.zeros(n, np.uint64)
    for j in [*range(values - 1, -1, -1)] * 2:
        e = empty[:, j]
        away = np.where(e, away + np.uint64(1), np.uint64(0))
        from_here = np.where(e, from_here, out[:, j])
        out[e, j] = (mix(from_here[e] + (away[e] << np.uint64(40))) & _EMPTY)
    return out.astype(np.uint32), distinct


def line_keys(s: Slice, k: int, bands: int, rows: int, short: int) -> pa.Array:
    """Band keys of each line, as a list array."""
    n = np.maximum(1, s.c1 - s.c0 - k + 1)  # positions; only lines near or over the limit have their shingles counted
    least = short * 4 // 5
    many = np.flatnonzero(n >= least)
    keys = [np.zeros((0, bands), np.int64)] * 2
    if len(many):
        binned, n[many] = _binned_counted(*s.shingles(k, many), bands * rows)
        binned, many = binned[n[many] >= least], many[n[many] >= least]
        keys[1] = band_keys(binned, bands, rows, salt=bands)
    few = np.flatnonzero(n <= short)
    if len(few):
        keys[0] = band_keys(_minima(*s.shingles(k, few), bands * rows), bands, rows)
    owner = np.concatenate([few, many])
    order = np.argsort(owner, kind="stable")
    flat = np.concatenate(keys)[order].ravel()
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)) * bands)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def line_sets(lines: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each of some lines."""
    off = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
    off[-1] -= 1
    s = Slice(np.frombuffer(b"\n".join(lines), np.uint8), off)
    h, at = s.shingles(k, np.arange(len(s.row)))
    for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
        h[x:y].sort()
    new = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    new[at[:-1]] = True
    h, ends = h[new], np.cumsum(new)[at[1:] - 1].tolist()
    return [h[x:y] for x, y in zip([0, *ends], ends)]


def _lines(docs: DataFrame, k: int, bands: int, rows: int, short: int) -> DataFrame:
    """A row a line: doc_id, text_hash, line_no, d1, d2, keys."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, off in text_slices(b.column(1)):
                s = Slice(data, off)
                if not len(s.row):
                    continue
                row = pa.array(first + s.row)
                cols = [b.column(0).take(row), b.column(2).take(row), pa.array(s.number, pa.int64()), *map(pa.array, s.digests()), line_keys(s, k, bands, rows, short)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "line_no", "d1", "d2", "keys"])

    schema = "doc_id bigint, text_hash bigint, line_no bigint, d1 bigint, d2 bigint, keys array<bigint>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(tidy(read), schema)


def fuzzy_lines(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, short: int = SHORT) -> DataFrame:
    """Every line of ``docs`` (doc_id, text) that is alike another: doc_id, line_no (from 0), keep_doc_id,
    keep_line_no (the line kept in its place), kept (it is that line itself), text_hash (xxhash64 of its text).

    Lines are linked if 100 * intersection >= threshold * union of their sets of ``k``-character shingles.
    """
    text = docs.select("doc_id", "text")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "text_hash")
    every = stored(_lines(text, k, bands, rows, short), "every-line", "uncompressed")
    own = every.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.first("keys").alias("keys"))
    items = stored(own.withColumn("cid", F.monotonically_increasing_id()), "lines", "uncompressed")

    def prepare(cids: DataFrame) -> Comparison:
        picked = stored(cids.join(items.select("cid", "first.doc_id", "d1", "d2"), "cid"), "candidates")
        ids = picked.select("cid", "d1", "d2")
        ids = F.broadcast(ids) if small_enough(ids) else ids

        def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, data, off in text_slices(b.column(0)):
                    s = Slice(data, off)
                    if not len(s.row):
                        continue
                    yield pa.RecordBatch.from_arrays([*map(pa.array, s.digests()), pa.array([data[x:y].tobytes() for x, y in zip(s.start, s.end)], pa.binary())], names=["d1", "d2", "line"])

        found = semi_by(text, picked, "doc_id").select("text").mapInArrow(tidy(profile), "d1 bigint, d2 bigint, line binary").join(ids, ["d1", "d2"])
        profiles = stored(found.dropDuplicates(["cid"]).select("cid", "line"), "profiles")

        def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, len(b), 1024):
                    part = b.slice(i, 1024)
                    ids = np.concatenate([part.column(0).to_numpy(), part.column(1).to_numpy()])
                    _, one, which = np.unique(ids, return_index=True, return_inverse=True)  # a hub's line is cut once
                    lines = [*part.column(2).to_pylist(), *part.column(3).to_pylist()]
                    lines = [lines[j] for j in one.tolist()]
                    sets = line_sets(lines, k)
                    linked = []
                    for x, y in zip(which[: len(part)].tolist(), which[len(part) :].tolist()):
                        both = common(sets[x], sets[y])
                        linked.append(100 * both >= threshold * (len(sets[x]) + len(sets[y]) - both))
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(linked, pa.bool_())) for c in part.columns[:2]], names=["a", "b"])

        def verify(pairs: DataFrame) -> DataFrame:
            x, y = (profiles.select(F.col("cid").alias(c), F.col("line").alias(f"line_{c}")) for c in "ab")
            return pairs.join(y, "b").join(x, "a").select("a", "b", "line_a", "line_b").mapInArrow(tidy(confirm), "a bigint, b bigint")

        payload = profiles.select("cid", F.col("line").alias("payload"))
        return Comparison(verify, payload, lambda lines: line_sets(lines, k), threshold, miss=1e-7)

    roots = banded_components(items.select("cid", "keys"), prepare)
    reached = items.select("cid", "d1", "d2", "n", "first").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    alike = stored(reached.where("n > 1 or root is not null").select("d1", "d2", "first", F.coalesce("root", "cid").alias("root")), "alike")
    keep = alike.groupBy("root").agg(F.min("first").alias("keep"))
    named = alike.join(keep, "root").select("d1", "d2", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"), F.col("keep.text_hash").alias("keep_hash"))
    named = stored(named, "named")
    named = F.broadcast(named) if small_enough(named) else named
    out = every.select("doc_id", "text_hash", "line_no", "d1", "d2").join(named, ["d1", "d2"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_doc_id")) & (F.col("line_no") == F.col("keep_line_no")) & F.col("text_hash").eqNullSafe(F.col("keep_hash"))
    return out.select("doc_id", "line_no", "keep_doc_id", "keep_line_no", kept.alias("kept"), "text_hash")


def drop_repeated_lines(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without lines that are alike a line kept elsewhere. Documents that lose all their lines go; documents
    without any line stay as they are, and so do texts that lose none. All columns stay; n_chars, if there, is recounted."""
    docs = _without_twins(docs)
    id_, hash_, lines_ = (free_name(docs, n) for n in ("line_doc_id", "line_text_hash", "lines_gone"))
    gone = fuzzy_lines(docs, k, threshold).where("not kept").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias(lines_))
    gone = stored(gone.withColumnsRenamed({"doc_id": id_, "text_hash": hash_}), "gone")  # a list holds one document's line numbers

    def rest(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        def cut(t, drop):
            if t is None or drop is None:
                return t
            drop = set(drop)
            left = [x for i, x in enumerate(t.split("\n")) if i not in drop]
            return "\n".join(left) if any(x.strip(" \t\n\r\x0b\x0c") for x in left) else None

        for text, lines in batches:
            yield pa.array([cut(t.as_py(), d.as_py()) for t, d in zip(text, lines)], pa.string())

    j = docs.join(gone, docs["doc_id"].eqNullSafe(gone[id_]) & (F.xxhash64(docs["text"]) == gone[hash_]), "left")
    j = j.withColumn("text", F.when(F.col(lines_).isNull(), docs["text"]).otherwise(arrow_column(rest, "string", 2)(docs["text"], F.col(lines_))))
    j = j.where(F.col(lines_).isNull() | F.col("text").isNotNull())
    if "n_chars" in docs.columns:
        j = j.withColumn("n_chars", F.when(F.col(lines_).isNull(), docs["n_chars"]).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return j.select(*docs.columns)


def _without_twins(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of those with equal doc_id and text that hold a line; what a line of either would lose, both would keep."""
    twin, id_, key = (free_name(docs, n) for n in ("twin", "twin_doc_id", "twin_text_hash"))
    line = F.length(F.trim(F.col("text"), F.lit(" \t\n\r\x0b\x0c"))) > 0
    keys = docs.where(line).groupBy(F.col("doc_id").alias(id_), F.xxhash64("text").alias(key)).agg(F.count("*").alias(twin)).where(F.col(twin) > 1)
    keys = stored(keys, "twins")
    if keys.isEmpty():
        return docs
    side = F.broadcast(keys) if small_enough(keys) else keys
    marked = docs.join(side, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)) & line, "left")
    single = marked.where(F.col(twin).isNull()).select(*docs.columns)
    return single.unionByName(marked.where(F.col(twin).isNotNull()).select(*docs.columns).dropDuplicates(["doc_id", "text"]))
