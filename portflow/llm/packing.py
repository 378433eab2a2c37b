"""Packing documents into fixed windows by non-negative least squares over shallow length combinations.

A document of n ids fills ``n // window`` sequences by itself and leaves a rest of ``n % window`` ids. The histogram of
rests (at most ``window - 1`` numbers, whatever the corpus) goes to the driver. Combinations of two or three lengths
that fill a window exactly are enumerated; non-negative least squares finds how often to repeat each so that their
lengths add up to the histogram; the counts are rounded down to whole numbers that the histogram holds. Each rest
then finds its place from its rank among the rests of its length (a count within its task plus the counts of earlier
tasks), so nothing is sorted or gathered. Rests that no combination took are packed greedily one after the other
into further windows and cut where a window ends: only the last window has padding.

A task reads a text once and stores its ids with their count; a second pass over the stored ids cuts them into pieces,
each with its place and its own ids. ``sequences`` joins the pieces of each sequence.

Edge cases: a null text is empty and is packed as its end id; null or repeated doc_ids are documents of their own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_enough, stored, tidy
from .tokens import MEMO, default_vocabulary, encoder

WINDOW = 1024
TRIPLE_STEP = 16  # the smallest part of an enumerated triple is a multiple of this
SWEEPS = 30

_LENGTHS = pa.schema([("task", pa.int32()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("rest", pa.int32()), ("rank", pa.int64()), ("full_rank", pa.int64()), ("ids", pa.binary())])
_LENGTHS_SQL = "task int, doc_id bigint, doc_tokens bigint, rest int, rank bigint, full_rank bigint, ids binary"


def measure(docs: DataFrame, window: int, vocabulary: str | None, end_id: int, memo: int = MEMO) -> DataFrame:
    """A row a document: its ids (little-endian unsigned 32-bit, the end id last) and their count. ``rank`` and
    ``full_rank`` count the rests of the same length and the full windows that the task has had before."""
    path = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, fulls = encoder(path, memo).encode, TaskContext.get().partitionId(), 0
        seen = np.zeros(window, np.int64)
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc(t.as_py()) + end
                n = len(ids) // 4
                rest = n % window
                out.append((task, i, n, rest, int(seen[rest]), fulls, ids))
                seen[rest] += 1
                fulls += n // window
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _LENGTHS)] if out else [pa.array([], f.type) for f in _LENGTHS], schema=_LENGTHS)

    return docs.select("doc_id", "text").mapInArrow(tidy(cut, encodes=True), _LENGTHS_SQL)


def combinations(window: int, step: int = TRIPLE_STEP) -> np.ndarray:
    """Length combinations (ascending, three columns, 0 for none) that fill a window: all pairs, then triples whose
    smallest part is a multiple of ``step``."""
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([np.zeros_like(a), a, window - a], 1)
    triples = [(x, y, window - x - y) for x in range(step, window // 3 + 1, step) for y in range(x, (window - x) // 2 + 1)]
    return np.concatenate([pairs, np.array(triples, int).reshape(-1, 3)])


def nnls(combos: np.ndarray, histogram: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Repeats x >= 0 that minimise ||A x - histogram||; column c of A counts the lengths of combination c.

    Coordinate descent: each coordinate in turn takes its best non-negative value given the others. Combinations that
    use a length the histogram lacks are left out.
    """
    lack = histogram <= 0
    lack[0] = False
    use = np.flatnonzero(~lack[combos].any(1))
    x = np.zeros(len(combos))
    left = histogram.astype(float).tolist()
    cols = []
    for c in use.tolist():
        part = {}
        for v in combos[c].tolist():
            if v:
                part[v] = part.get(v, 0) + 1
        cols.append((c, list(part.items()), float(sum(k * k for k in part.values()))))
    for _ in range(sweeps):
        moved = 0.0
        for c, part, norm in cols:
            d = max(-x[c], sum(k * left[v] for v, k in part) / norm)
            if d:
                x[c] += d
                for v, k in part:
                    left[v] -= k * d
                moved = max(moved, abs(d))
        if moved < 0.5:
            break
    return x


def plan(histogram: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(combinations used, whole repeats): least squares rounded down, then kept within the histogram, so that the
    rests placed never exceed those there are."""
    combos = combinations(window)
    want = np.floor(nnls(combos, histogram) + 0.5).astype(np.int64)
    left, kept = histogram.astype(np.int64).copy(), []
    for c in np.flatnonzero(want).tolist():
        v, k = np.unique(combos[c][combos[c] > 0], return_counts=True)
        r = int(min(want[c], (left[v] // k).min()))
        if r > 0:
            left[v] -= r * k
            kept.append((c, r))
    return combos[[c for c, _ in kept]].reshape(-1, 3), np.array([r for _, r in kept], np.int64)


def slots(combos: np.ndarray, repeats: np.ndarray, window: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: its uses in order, as (last rank + 1, first sequence, offset in the sequence)."""
    first = np.concatenate([[0], np.cumsum(repeats)])
    out: dict[int, list] = {}
    for c, parts in enumerate(combos.tolist()):
        at = 0
        for v in parts:
            if v:
                out.setdefault(v, []).append((int(repeats[c]), int(first[c]), at))
                at += v
    return {v: (np.cumsum([u[0] for u in us]), np.array([u[1] for u in us]), np.array([u[2] for u in us]), np.array([u[0] for u in us])) for v, us in out.items()}


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
_PIECES_SQL = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, end_id: int = 0, memo: int = MEMO) -> DataFrame:
    """Pieces of all documents (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    the piece's ids (little-endian unsigned 32-bit), of which ids_crc32 is the checksum.

    Sequence ids: first those of the combinations, then full windows of long documents, then the greedy ones.
    """
    rows = stored(measure(docs, window, vocabulary, end_id, memo), "lengths")
    counts = stored(rows.groupBy("task", "rest").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(window, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # at most window rows
        if r.rest:
            histogram[r.rest] = r.n
    combos, repeats = plan(histogram, window)
    where = slots(combos, repeats, window)
    taken = np.array([int(where[v][0][-1]) if v in where else 0 for v in range(window)], np.int64)
    left_ids = (histogram - taken) * np.arange(window)
    greedy_at = np.cumsum(left_ids) - left_ids  # the rests left over stand in order of length and rank
    n_combined = int(repeats.sum())

    earlier = Window.partitionBy("rest").orderBy("task")  # a row a task in each
    before = counts.select("task", "rest", (F.sum("n").over(earlier) - F.col("n")).alias("before"))
    fulls = rows.groupBy("task").agg(F.sum(F.expr(f"doc_tokens div {window}")).alias("fulls"))
    full_from = stored(fulls.select("task", (F.sum("fulls").over(Window.orderBy("task")) - F.col("fulls")).alias("full_from"), "fulls"), "fulls")
    n_full = int(full_from.agg(F.sum("fulls").alias("n")).first().n or 0)
    greedy_from = n_combined + n_full
    before = stored(before.join(full_from.select("task", "full_from"), "task"), "before")
    before = F.broadcast(before) if small_enough(before) else before

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, n, rest, rank, full_rank, before, full_from, ids in zip(*(c.to_pylist() for c in b.columns)):

                def piece(start, length, sequence, offset):
                    out.append((doc, start, length, n, sequence, offset, ids[4 * start : 4 * (start + length)]))

                for j in range(n // window):
                    piece(j * window, window, n_combined + full_from + full_rank + j, 0)
                if not rest:
                    continue
                g, start = rank + before, n - rest
                if g < taken[rest]:
                    ends, first, offset, many = where[rest]
                    k = int(np.searchsorted(ends, g, "right"))
                    piece(start, rest, int(first[k] + g - (ends[k] - many[k])), int(offset[k]))
                    continue
                at = int(greedy_at[rest] + (g - taken[rest]) * rest)
                k = min(rest, window - at % window)  # of this rest, what the window takes; the next window has the others
                piece(start, k, greedy_from + at // window, at % window)
                if k < rest:
                    piece(start + k, rest - k, greedy_from + at // window + 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECES)] if out else [pa.array([], f.type) for f in _PIECES], schema=_PIECES)

    placed = rows.join(before, ["task", "rest"]).select("doc_id", "doc_tokens", "rest", "rank", "full_rank", "before", "full_from", "ids")
    return placed.mapInArrow(tidy(place), _PIECES_SQL).withColumn("ids_crc32", F.crc32("ids")).select(*COLUMNS, "ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences of ``pieces`` (as ``pack`` gives them): sequence_id, n_ids (at most a window), ids (of all its
    pieces, in order), parts (doc_id, start, length, offset of each piece)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("p")  # at most a window's
    return pieces.groupBy("sequence_id").agg(parts).select(
        "sequence_id",
        F.expr("aggregate(p, 0L, (n, x) -> n + x.length)").alias("n_ids"),
        F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"),
        F.expr("transform(p, x -> struct(x.doc_id, x.start, x.length, x.offset))").alias("parts"),
    )
