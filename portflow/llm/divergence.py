"""Divergence of sources by their terms: a frequent-pattern tree of term rows gives what each pair of sources shares.

Every language keeps the terms that stand in at least ``MIN_DOCS`` of its documents (V of them). A source of the
language has, for a kept term, ``p = 1 + floor(SCALE * (count + 1) / (N + V))``; ``z`` is that p for a count of 0. The
divergence of two sources is the sum over all kept terms of ``f(p, q) = floor((p - q)^2 / q)``. Most terms are absent
from most sources, so a pair's sum is written as

    V f(z, z') + sum over terms of the one source  [f(p, z') - f(z, z')] + the same for the other
               + sum over terms of both            [f(p, p') - f(p, z') - f(z, p') + f(z, z')]

The first line needs, for each source, how many terms have which p. The second is the tree's work: a term's row, its
nonzero counts in the order of sources, is a path; equal rows are one path with a multiplicity. Paths are spread over
tasks in sorted order, in which the tree is walked depth first with one path in memory: a node's multiplicity is the
sum over the run of rows that share its prefix, and each combination of a node with an ancestor adds its correction
once, times that multiplicity. A node whose rows fall into two tasks is added in both with its part of them.

All numbers are whole and exact: p is at most SCALE + 1, squares fit 64 bits, and sums are kept as two halves of 32
bits in tasks and as decimals in Spark.

Counting is one pass over whole texts (long ones in pieces cut between terms); a task adds up equal terms of a source
before they are shuffled, so neither a frequent term nor a hot source gathers more than a row a task and term. The
200 best terms of a source are cut before the shuffle as well. Rows a task holds: ``ENTRIES`` counts, or one path.
Pairs of sources of one language are the result itself; nothing else is paired.

Edge cases: null text, lang or source is ''; a document without terms, or a group without kept terms, still makes its
group appear (N is 0), and the only source of its language has no pairs; a language without kept terms has pairs of
value 0; every row of the table is a document, also rows with the same or no doc_id; ties go to the smaller item in
UTF-8 order; an empty table gives no rows; other columns are ignored.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
ENTRIES = 500_000  # counts that a task gathers before it passes them on
ONE_DOC = 1 << 48
PIECE = 1 << 20
BIG = "decimal(38,0)"
# Bytes of terms are letters and all beyond ASCII; A-Z is read as a-z, every other byte ends a term.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_END = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: bytes) -> Counter:
    """How often each term stands in a text, in pieces of about ``PIECE`` bytes."""
    out, i = Counter(), 0
    while i < len(text):
        cut = _END.search(text, i + PIECE)
        j = cut.start() if cut else len(text)
        out.update(text[i:j].translate(_TERM).split())
        i = j
    return out


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); the groups of ``docs`` have '' for null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}  # a term's number: documents in the high digits, occurrences below
        size = 0

        def flush():
            langs, sources, found, numbers = [], [], [], []
            for (lang, source), group in held.items():
                langs += [lang] * len(group)
                sources += [source] * len(group)
                found += group.keys()
                numbers += group.values()
            cols = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(found, pa.binary()).cast(pa.string())]
            cols += [pa.array([x % ONE_DOC for x in numbers], pa.int64()), pa.array([x // ONE_DOC for x in numbers], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, schema=_COUNTS)

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                group = held.setdefault((lang, source), {})
                size -= len(group)
                get = group.get
                for t, n in terms(text.as_buffer().to_pybytes()).items():
                    group[t] = get(t, 0) + n + ONE_DOC
                size += len(group)
                if size >= ENTRIES:
                    yield flush()
                    held, size = {}, 0
        if size:
            yield flush()

    return _groups(docs).select("lang", "source", "text").mapInArrow(tidy(count), "lang string, source string, term string, n bigint, docs bigint")


def _groups(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _p(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + 1) / (total + kept)); needs kept > 0."""
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(20,0)") * (count + 1), (total + kept).cast("decimal(20,0)"))).cast("long")


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk sorted paths (lang, source numbers, p, z, multiplicity): a, b, hi, lo by language, where the pair correction
    of the sources a and b (f's second argument) is hi * 2**32 + lo."""
    triangle: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    for b in batches:
        langs, paths, many = b.column(0).to_pylist(), b.column(1), np.asarray(b.column(2))
        flat = paths.flatten()
        source, p, z = (np.asarray(flat.field(i)).astype(np.int64) for i in range(3))
        off = np.asarray(paths.offsets).astype(np.int64) - paths.offsets[0].as_py()
        pick_a, pick_b, weight, of = [], [], [], []
        mult = np.zeros(len(source), np.int64)  # of the node that a place of a path makes; 0 where an earlier row made it
        made: list[int] = []  # by depth, the place of the node that the current path stands on
        for r in range(len(langs)):
            lo, hi = off[r], off[r + 1]
            same = 0
            if r and langs[r] == langs[r - 1]:
                most = min(len(made), hi - lo)
                was = off[r - 1]
                differ = np.flatnonzero((source[lo : lo + most] != source[was : was + most]) | (p[lo : lo + most] != p[was : was + most]))
                same = int(differ[0]) if len(differ) else most
            made = made[:same] + list(range(lo + same, hi))
            mult[made] += many[r]
            pick = triangle.get((same, hi - lo))
            if pick is None:
                below, node = np.triu_indices(hi - lo, 1)
                pick = triangle[same, hi - lo] = (below[node >= same], node[node >= same])
            pick_a.append(pick[0] + lo)
            pick_b.append(pick[1] + lo)
            of.append(np.full(len(pick[0]), r))
        if not pick_a:
            continue
        a, n, of = np.concatenate(pick_a), np.concatenate(pick_b), np.concatenate(of)
        names, lang = np.unique(np.array(langs, object), return_inverse=True)
        have, number = np.unique(source, return_inverse=True)
        code, where = (lang[of] * len(have) + number[a]) * len(have) + number[n], None
        if len(names) * len(have) ** 2 > 1 << 20:  # too many for a sum a pair that may occur
            code, where = np.unique(code, return_inverse=True)
        else:
            code, where = np.arange(len(names) * len(have) ** 2), code
        first, second = have[code // len(have) % len(have)], have[code % len(have)]
        in_lang = names[code // len(have) ** 2]
        many_n = mult[n]
        for left, right, x, y in ((first, second, a, n), (second, first, n, a)):
            px, py, zx, zy = p[x], p[y], z[x], z[y]
            value = f(px, py) - f(px, zy) - f(zx, py) + f(zx, zy)
            hi, lo = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
            np.add.at(hi, where, (value >> 32) * many_n)
            np.add.at(lo, where, (value & 0xFFFFFFFF) * many_n)
            k = np.flatnonzero((hi != 0) | (lo != 0))
            yield pa.RecordBatch.from_arrays([pa.array(in_lang[k], pa.string()), pa.array(left[k]), pa.array(right[k]), pa.array(hi[k]), pa.array(lo[k])], names=["lang", "a", "b", "hi", "lo"])


def source_divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: parts `pair` (every other source of the language) and `term` (the best terms)."""
    # one shuffle: what is dealt by (lang, term) is dealt by (lang, source, term) as well
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    row = F.collect_list(F.struct("source", "n")).alias("row")  # an entry a source at most
    rows = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), row)
    rows = stored(rows.where(F.col("docs") >= MIN_DOCS).select("lang", "term", "total", "row"), "term-rows")

    entries = rows.select("lang", "term", "total", F.explode("row").alias("e")).select("lang", "term", "total", "e.source", "e.n")
    by_lang = rows.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_sum"))
    by_group = entries.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    groups = _groups(docs).select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sum", "kept", "lang_sum")])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row a source
    z = F.when(F.col("kept") > 0, _p(F.lit(0), F.col("sum"), F.col("kept"))).otherwise(F.lit(1))
    groups = stored(groups.withColumn("number", number).withColumn("z", z.cast("long")), "groups")

    entries = entries.join(groups, ["lang", "source"]).withColumn("p", _p(F.col("n"), F.col("sum"), F.col("kept")))
    entries = entries.withColumn("q", _p(F.col("total"), F.col("lang_sum"), F.col("kept")))
    best = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = best.withColumn("rank", order).where(F.col("rank") <= TOP_TERMS)

    path = F.sort_array(F.collect_list(F.struct("number", "p", "z"))).alias("path")
    paths = entries.groupBy("lang", "term").agg(path).groupBy("lang", "path").agg(F.count("*").alias("many"))
    paths = stored(paths, "paths").where(F.size("path") > 1).repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    both = paths.select("lang", "path", "many").mapInArrow(tidy(corrections), "lang string, a bigint, b bigint, hi bigint, lo bigint")
    big = lambda c: F.col(c).cast(BIG)
    both = both.select("lang", "a", "b", (big("hi") * F.lit(1 << 32) + big("lo")).cast(BIG).alias("add"))

    one = entries.groupBy("lang", F.col("number").alias("x"), F.col("z").alias("zx"), "p").agg(F.count("*").alias("many"))
    other = groups.select("lang", F.col("number").alias("y"), F.col("z").alias("zy"), "kept")
    side = one.join(other, "lang").where("x <> y")  # how many terms of a source have which p, with the other sources' z
    change = lambda left, right, l0, r0: (F.col("many").cast(BIG) * (_f(F.col(left), F.col(right)) - _f(F.col(l0), F.col(r0)))).cast(BIG)
    first = side.select("lang", F.col("x").alias("a"), F.col("y").alias("b"), change("p", "zy", "zx", "zy").alias("add"))
    second = side.select("lang", F.col("y").alias("a"), F.col("x").alias("b"), change("zy", "p", "zy", "zx").alias("add"))
    left = groups.select("lang", F.col("number").alias("a"), "source", F.col("z").alias("za"))
    right = groups.select("lang", F.col("number").alias("b"), F.col("source").alias("item"), F.col("z").alias("zb"), "kept")
    pairs = left.join(right, "lang").where("a <> b")
    adds = both.unionByName(first).unionByName(second).groupBy("lang", "a", "b").agg(F.sum("add").alias("add"))
    value = F.col("kept").cast(BIG) * _f(F.col("za"), F.col("zb")) + F.coalesce("add", F.lit(0).cast(BIG))
    pairs = pairs.join(adds, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    pairs = pairs.withColumn("rank", order)
    return pairs.unionByName(best)
