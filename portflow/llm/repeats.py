"""Repeated passages: every byte under a string of ``LENGTH`` bytes that also starts elsewhere, by hash-compared suffix sort.

1. Texts that occur more than once as a whole are one class each: all their bytes go (if long enough), and one of them
   stands for the class below, so copies cost nothing more.
2. Every window of ``LENGTH`` bytes has an anchor: its ``GRAM``-byte string with the smallest hash (the leftmost of
   equals). Equal windows have equal anchors at equal places, so only anchors whose hash occurs again can lie in a
   repeat: about one byte in a hundred is an anchor, and only repeated ones get their context (what any window that
   holds the anchor can hold).
3. The contexts of an anchor are suffixes from the anchor on and reversed prefixes before it. Both are sorted by
   mergesort, all groups of a batch at once: two suffixes are compared by binary search for their common extension
   over prefix polynomial hashes, then by the next byte. Neighbours' common extensions are verified on the bytes; a
   batch with a hash collision is sorted by its bytes instead.
4. A window that holds l bytes before the anchor is repeated if another context shares l bytes before and
   ``LENGTH`` - l bytes from the anchor on. The neighbours' extensions cut both orders into classes for every l, so
   windows in the same pair of classes are repeats: no pair of contexts is ever listed.
5. Before they are sorted, equal contexts collapse, and large groups are split until their parts can be sorted
   (``split_groups``). A part holds the contexts that share all bytes which its windows, from ``lo`` to ``hi`` bytes
   before the anchor, have in common; contexts that are equal over all bytes of these windows are repeats from end to
   end, leave one span each and one of them for the rest. Parts of more than ``MOST`` such classes are split by narrower
   ranges of windows. Hashes are counted by Spark with map-side combine: no task holds a large group, and a context
   leaves spans, never its windows.

Edge cases: null and empty texts have nothing to remove; texts shorter than ``LENGTH`` bytes neither lose bytes nor
match; rows that repeat a doc_id are texts of their own, and equal rows are copies of each other; null doc_ids are
ids like others; an empty table gives no rows; other columns are ignored.
"""

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import powers, prefix_hash, small_enough, span_hashes, stored, text_slices, tidy

LENGTH, GRAM = 400, 200
MOST = 5_000  # classes of contexts that are sorted together at most
BATCH = 2_000  # contexts that are sorted together, unless one group has more
FAN = 4  # ranges that a large part is split into

_OTHER_BYTE = np.random.Generator(np.random.PCG64(4711)).integers(1, 1 << 64, 256, dtype=np.uint64)


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all windows that lie within a row."""
    n = len(data) - gram + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    h = span_hashes(prefix_hash(C._BYTE[data]), at, at + gram)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (h >> bits << bits) | at.astype(np.uint64)  # smallest hash, then leftmost
    wide, need = 1, length - gram + 1
    while 2 * wide <= need:
        key = np.minimum(key[:-wide], key[wide:])
        wide *= 2
    if wide < need:
        key = np.minimum(key[: len(key) - (need - wide)], key[need - wide :])
    inside = np.zeros(len(key) + 1, np.int32)  # windows that lie within a row
    a, b = off[:-1], off[1:] - length + 1
    a, b = a[b > a], b[b > a]
    np.add.at(inside, a, 1)
    np.add.at(inside, b, -1)
    chosen = np.zeros(n, bool)
    chosen[(key & np.uint64((1 << int(bits)) - 1))[np.cumsum(inside[:-1]) > 0].astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    return at, h[at]


class Suffixes:
    """Byte strings (rows of ``text``, ``size`` bytes each) within groups (``group`` ascends), sorted in each group."""

    def __init__(self, text: np.ndarray, size: np.ndarray, group: np.ndarray):
        self.text, self.size, self.group = text, size, group
        n, width = text.shape
        self.prefix = np.zeros((n, width + 1), np.uint64)
        np.cumsum(C._BYTE[text] * powers(C._P, width), axis=1, out=self.prefix[:, 1:])
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        first = np.repeat(start, np.diff(np.concatenate([start, [n]])))
        end = np.repeat(np.concatenate([start[1:], [n]]), np.diff(np.concatenate([start, [n]])))
        self.order = self._mergesort(first, end)
        self.common = self._neighbours()
        if not self._verified():
            rows = [(g, t[:s].tobytes()) for g, t, s in zip(group.tolist(), text, size.tolist())]
            self.order = np.array(sorted(range(n), key=rows.__getitem__))
            self.common = self._neighbours(exact=True)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix, by binary search for the longest prefixes with equal hashes."""
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi + 1) >> 1
            same = self.prefix[i, mid] == self.prefix[j, mid]
            lo = np.where(same & open_, mid, lo)
            hi = np.where(~same & open_, mid - 1, hi)

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: how i compares with j."""
        e = self.extension(i, j)
        width = self.text.shape[1]
        a = np.where(e < self.size[i], self.text[i, np.minimum(e, width - 1)].astype(np.int16), -1)
        b = np.where(e < self.size[j], self.text[j, np.minimum(e, width - 1)].astype(np.int16), -1)
        return np.sign(a - b)

    def _mergesort(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(first)
        order = np.arange(n)
        place = np.arange(n) - first  # in its group
        most = int((end - first).max()) if n else 0
        run = 1
        while run < most:
            number = place // run
            lo = np.minimum(first + (number ^ 1) * run, end)
            hi = np.minimum(lo + run, end)
            low = lo.copy()
            right = (number & 1).astype(bool)
            while True:
                k = np.flatnonzero(lo < hi)
                if not len(k):
                    break
                mid = (lo[k] + hi[k]) >> 1
                c = self.before(order[mid], order[k])
                less = (c < 0) | ((c == 0) & right[k])  # equals of the left run come first
                lo[k[less]] = mid[less] + 1
                hi[k[~less]] = mid[~less]
            to = first + (number & ~1) * run + (place - number * run) + (lo - low)
            new = np.empty_like(order)
            new[to] = order
            order = new
            run *= 2
        return order

    def _neighbours(self, exact: bool = False) -> np.ndarray:
        """For each place but the first: the common extension with the place before; -1 at the start of a group."""
        i, j = self.order[:-1], self.order[1:]
        if exact:
            differ = self.text[i] != self.text[j]
            e = np.where(differ.any(1), differ.argmax(1), self.text.shape[1])
            e = np.minimum(e, np.minimum(self.size[i], self.size[j]))
        else:
            e = self.extension(i, j)
        return np.where(self.group[i] == self.group[j], e, -1)

    def _verified(self) -> bool:
        """Whether neighbours' extensions are what their bytes say and the order is that of the bytes."""
        for a in range(0, len(self.common), 2048):
            i, j, e = self.order[a : a + 2048], self.order[a + 1 : a + 2049], self.common[a : a + 2048]
            i = i[: len(j)]
            x, y = self.text[i], self.text[j]
            if ((x != y) & (np.arange(self.text.shape[1]) < e[:, None])).any():
                return False
            k = np.flatnonzero(e >= 0)
            if (self.before(i[k], j[k]) > 0).any():
                return False
        return True

    def classes(self, at_least: int) -> np.ndarray:
        """By row: a number that rows share if they share their first ``at_least`` bytes; shorter rows stand alone."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.concatenate([[0], np.cumsum(self.common < at_least)])
        return out


def repeated_windows(group: np.ndarray, contexts: list[bytes], before: np.ndarray, length: int, gram: int) -> np.ndarray:
    """rows x (length - gram + 1) flags: whether the window with l bytes before the anchor is repeated in its group."""
    n, reach = len(contexts), length - gram
    size = np.array([len(c) for c in contexts]) - before
    right, left = np.zeros((n, length), np.uint8), np.zeros((n, reach), np.uint8)
    for i, (c, b) in enumerate(zip(contexts, before.tolist())):
        x = np.frombuffer(c, np.uint8)
        right[i, : len(x) - b] = x[b:]
        left[i, :b] = x[:b][::-1]
    ahead, behind = Suffixes(right, size, group), Suffixes(left, before, group)
    out = np.zeros((n, reach + 1), bool)
    for l in range(reach + 1):
        rows = np.flatnonzero((before >= l) & (size >= length - l))
        if len(rows) < 2:
            continue
        key = ahead.classes(length - l)[rows] * n + behind.classes(l)[rows]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(rows), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        out[rows, l] = again
    return out


_SPANS = "doc_id bigint, x bigint, a bigint, b bigint"


def _runs(flags: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end byte) covered by each run of repeated windows of a row."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, lo = np.nonzero(edge == 1)
    _, hi = np.nonzero(edge == -1)
    return row, at[row] - (hi - 1), at[row] - lo + length


_CONTEXT = ["h", "doc_id", "x", "at", "before", "context"]


def split_groups(contexts: DataFrame, length: int, gram: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(parts of at most ``most`` contexts, with a group number of their own in ``h``; spans already known to repeat).

    A part is a range of windows, ``lo`` to ``hi`` bytes before the anchor, of contexts that share the bytes common to
    all these windows (core). Two contexts that share a window of the range share its core, so they stay together.
    Contexts equal over all bytes of the range (whole) are one class: its windows repeat if it has two members, and one
    member meets the other classes. Contexts cut short by the ends of their texts have part of the range only and are
    classes of their own. A range of one window has one class a core, so the splitting ends.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 800):
                b = batch.slice(i, 800)
                c = b.column("context").cast(pa.large_binary())
                off = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
                data, off = np.frombuffer(c.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]
                before, lo, hi = (b.column(k).to_numpy().astype(np.int64) for k in ("before", "lo", "hi"))
                anchor = off[:-1] + before
                first, last = np.maximum(lo, length - (off[1:] - anchor)), np.minimum(hi, before)
                full = (first == lo) & (last == hi)
                some = np.flatnonzero(first <= last)
                prefixes = [prefix_hash(v[data]) for v in (C._BYTE, _OTHER_BYTE)]
                core = [span_hashes(p, (anchor - lo)[some], (anchor + length - hi)[some]) for p in prefixes]
                k = some[full[some]]
                whole = [np.zeros(len(full), np.uint64) for _ in prefixes]
                for w, p in zip(whole, prefixes):
                    w[k] = span_hashes(p, (anchor - hi)[k], (anchor - lo + length)[k])
                out = b.take(pa.array(some))
                added = [*(v.view(np.int64) for v in core), *(w[some].view(np.int64) for w in whole), full[some]]
                yield pa.RecordBatch.from_arrays([*out.columns, *map(pa.array, added)], names=[*out.schema.names, "c1", "c2", "w1", "w2", "full"])

    core, whole = ["h", "lo", "c1", "c2"], ["h", "lo", "c1", "c2", "w1", "w2"]
    row = "h bigint, doc_id bigint, x bigint, at bigint, before int, context binary, lo int, hi int"
    me = F.struct("doc_id", "x", "at")
    now = contexts.select(*_CONTEXT, F.lit(0).alias("lo"), F.lit(length - gram).alias("hi"))
    parts, spans = [], []
    while True:
        now = stored(now.mapInArrow(tidy(keys), f"{row}, c1 bigint, c2 bigint, w1 bigint, w2 bigint, full boolean"), "split")
        classes = stored(now.where("full").groupBy(*whole).agg(F.count("*").alias("n"), F.min(me).alias("one")), "classes")
        units = classes.select(*core).unionByName(now.where("not full").select(*core))
        cores = stored(units.groupBy(*core).agg(F.count("*").alias("k")).where("k > 1"), "cores")
        # these sides grow with the texts: they are merged at every size, and adaptive execution splits a hot class
        twice = classes.where("n > 1").select(*whole).hint("merge")
        spans.append(now.where("full").join(twice, whole, "left_semi").select("doc_id", "x", (F.col("at") - F.col("hi")).alias("a"), (F.col("at") - F.col("lo") + length).alias("b")))
        few = cores.hint("merge")
        more = classes.join(few, core).select("k", "one", F.col("h").alias("_h"), F.col("lo").alias("_lo"))  # classes that meet others
        more = more.hint("merge")
        # by the row itself: a class of any size sends one row to this join
        same = (F.col("h") == F.col("_h")) & (F.col("lo") == F.col("_lo")) & F.col("x").eqNullSafe(F.col("one.x")) & F.col("at").eqNullSafe(F.col("one.at")) & F.col("doc_id").eqNullSafe(F.col("one.doc_id"))
        alone = now.where("not full").join(few, core)
        on = now.where("full").join(more, same).select(*now.columns, "k").unionByName(alone)
        parts.append(on.where(F.col("k") <= most).select(F.xxhash64(*core).alias("h"), *_CONTEXT[1:]))
        rest = on.where(F.col("k") > most)
        if cores.where(F.col("k") > most).isEmpty():
            break
        step = F.ceil((F.col("hi") - F.col("lo") + 1) / FAN).cast("int")
        ranges = rest.withColumn("from", F.explode(F.sequence("lo", "hi", step)))
        now = ranges.select(*_CONTEXT, F.col("from").alias("lo"), F.least(F.col("from") + step - 1, "hi").cast("int").alias("hi"))
    together = lambda frames: functools.reduce(DataFrame.unionByName, frames)
    return together(parts), together(spans)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (the text's
    remaining bytes)."""
    reach = length - gram
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = text.withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("x", F.xxhash64("text"))
    long = text.where(F.col("n_bytes") >= length)
    copies = long.select("doc_id", F.md5("text").alias("m")).groupBy("m").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("rep")).where("n > 1")
    copies = stored(copies.select("m", "rep.doc_id").withColumnRenamed("doc_id", "rep"), "copies")
    few = F.broadcast(copies) if small_enough(copies) else copies
    marked = long.join(few, F.md5(long["text"]) == few["m"], "left")
    shown = marked.where(F.col("m").isNull() | F.col("doc_id").eqNullSafe(F.col("rep"))).select("doc_id", "x", "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, off in text_slices(b.column(2)):
                at, h = anchors(data, off, length, gram)
                row = np.searchsorted(off, at, "right") - 1
                take = pa.array(first + row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(at - off[row]), pa.array(h.view(np.int64))], names=["doc_id", "x", "at", "h"])

    found = shown.mapInArrow(tidy(find), "doc_id bigint, x bigint, at bigint, h bigint")
    found = stored(found, "anchors")
    again = stored(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "again")
    places = found.join(again, "h")
    lists = stored(places.groupBy("doc_id", "x").agg(F.collect_set(F.struct("at", "h")).alias("places")), "places")  # one document's anchors

    def semi(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        ids = ids.select(F.col("doc_id").alias("_id"), F.col("x").alias("_x")).distinct()
        ids = F.broadcast(ids) if small_enough(ids) else ids
        return df.join(ids, df["doc_id"].eqNullSafe(ids["_id"]) & (df["x"] == ids["_x"]), how)

    def with_lists(df: DataFrame, lists: DataFrame, column: str) -> DataFrame:
        other = lists.select(F.col("doc_id").alias("_id"), F.col("x").alias("_x"), column)
        return semi(df, lists, "left_semi").join(other, df["doc_id"].eqNullSafe(F.col("_id")) & (df["x"] == F.col("_x"))).drop("_id", "_x")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _CONTEXT
        for b in batches:
            for doc, x, t, places in zip(*b.columns):
                data, out = t.as_buffer().to_pybytes(), []
                for p in places.as_py():
                    at, h = p.values()
                    a = max(0, at - reach)
                    out.append((h, doc.as_py(), x.as_py(), at, at - a, data[a : at + length]))
                    if len(out) == 4_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    contexts = with_lists(shown, lists, "places").mapInArrow(tidy(cut), "h bigint, doc_id bigint, x bigint, at bigint, before int, context binary")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def spans(rows: list[tuple]) -> pa.RecordBatch:
            h, doc, x, at, before, context = zip(*rows)
            flags = repeated_windows(np.array(h), list(context), np.array(before), length, gram)
            row, a, b = _runs(flags, np.array(at), length)
            return pa.RecordBatch.from_arrays([pa.array([doc[r] for r in row], pa.int64()), pa.array([x[r] for r in row], pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "x", "a", "b"])

        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns))
            while len(held) > BATCH:
                k = BATCH  # whole groups only
                while k < len(held) and held[k][0] == held[k - 1][0]:
                    k += 1
                if k == len(held):
                    break  # the last group may go on
                yield spans(held[:k])
                held = held[k:]
        if held:
            yield spans(held)

    parts, done = split_groups(contexts, length, gram, most)
    spans = parts.repartition("h").sortWithinPartitions("h").mapInArrow(tidy(sort), _SPANS).unionByName(done)
    cover = stored(spans.groupBy("doc_id", "x").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans")), "spans")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, t, spans in zip(*b.columns):
                data, kept, end, runs = t.as_buffer().to_pybytes(), [], 0, 0
                for s in spans.as_py():
                    if s["a"] > end or not runs:
                        kept.append(data[end : s["a"]])
                        runs += 1
                    end = max(end, s["b"])
                rest = b"".join([*kept, data[end:]])
                out.append((doc.as_py(), len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), shape)] if out else [pa.array([], k) for k in shape], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    shape = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    single = marked.where("m is null").select("doc_id", "x", "text")
    part = with_lists(single, cover, "spans").select("doc_id", "text", "spans").mapInArrow(tidy(keep), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    zero = F.lit(0).cast("long")
    whole = lambda df: df.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    gone = marked.where("m is not null").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit(b"").alias("kept"))
    short = text.where(F.col("n_bytes") < length)
    return part.unionByName(whole(semi(single, cover, "left_anti"))).unionByName(gone).unionByName(whole(short))
