"""Benchmark decontamination: CGK embedding, repeated bit-sampling LSH, exact edit distance.

An item is contaminated text if a document holds a passage within ``floor(MAX_EDIT * words)`` word edits of it (words
are lower-cased runs without white space).

1. Windows: a window has an item's number of words. With at most e edits, one of e + 1 pieces of the item stands
   unchanged in the passage (pigeonhole), so windows are placed where a piece of an item is found, no other place can
   hold a match. The pieces' hashes are a bitmap and a sorted list.
2. The Chakraborty-Goldenberg-Koucky walk copies a window to three times its length: at every step it emits the word
   under the pointer, and a random bit of (step, word) says whether the pointer moves. Two sequences few edits apart
   soon walk in step again, so edit distance becomes Hamming distance. ``WALKS`` independent walks are made.
3. Each repetition of the LSH samples ``BITS`` places of one walk; a window and an item of its length whose samples are
   equal are candidates. The number of repetitions follows from ``RECALL``: items are edited at random to the
   largest distance allowed, and the share of equal samples gives the repetitions needed.
4. Candidates are verified exactly by bit-parallel approximate matching (Myers) of the item against the window with a
   margin of the allowed edits on both sides.

The benchmark goes to the tasks in blocks of at most ``ITEMS`` items; a larger benchmark takes more passes. Documents
are read once a block, nothing is shuffled and no document leaves its task.

Edge cases: null and empty texts hold nothing; items that are null or have fewer than ``MIN_WORDS`` words are no
passages and are ignored; equal items are reported each; rows that repeat a doc_id give a row each; an empty
benchmark or table gives no rows; other columns are ignored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, mix, text_slices, word_hashes, tidy

MAX_EDIT = 0.2
MIN_WORDS = 5
WALKS, BITS, RECALL = 8, 2, 0.995
ITEMS = 20_000
_PAD = np.uint64(0)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def piece_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    n = len(words) - k + 1
    if n <= 0:
        return words[:0]
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = mix(h * _GOLD + words[j : j + n])
    return h


def embed(windows: np.ndarray, lengths: np.ndarray, walk: np.ndarray) -> np.ndarray:
    """CGK images of padded windows (rows), each with the walk of its row; 3 * columns symbols."""
    n, width = windows.shape
    out = np.zeros((n, 3 * width), np.uint64)
    at, rows = np.zeros(n, np.int64), np.arange(n)
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], 1)
    for step in range(3 * width):
        now = np.where(at < lengths, padded[rows, np.minimum(at, width)], _PAD)
        out[:, step] = now
        at += (mix(now + (walk + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03) + np.uint64((step + 1) * int(_GOLD) % (1 << 64))) & np.uint64(1)).astype(np.int64)
    return out


def sample_keys(windows: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> np.ndarray:
    """LSH keys: windows x repetitions. ``places``: repetitions x bits, as shares of the image's length."""
    n, reps = len(windows), len(places)
    keys = np.zeros((n, reps), np.uint64)
    for w in range(min(WALKS, reps)):
        image = embed(windows, lengths, np.full(n, w, np.uint64))
        for r in range(w, reps, WALKS):
            at = (places[r][None, :] * (3 * lengths[:, None])).astype(np.int64)
            h = mix(lengths.astype(np.uint64) * _GOLD + np.uint64(r + 1))
            for j in range(places.shape[1]):
                h = mix(h * _GOLD + image[np.arange(n), at[:, j]])
            keys[:, r] = h
    return keys


def repetitions(items: list[np.ndarray], max_edit: float, bits: int, recall: float, seed: int = 5) -> int:
    """Repetitions that reach ``recall`` for items edited at random to the largest distance (a sample of 64 items)."""
    g = np.random.Generator(np.random.PCG64(seed))
    picked = [items[i] for i in g.permutation(len(items))[:64]]
    pairs = []
    for x in picked:
        for _ in range(4):
            y = list(x)
            for _ in range(int(max_edit * len(x))):
                kind, at = g.integers(3), int(g.integers(len(y)))
                if kind == 0:
                    y[at] = g.integers(1, 1 << 63, dtype=np.uint64)
                elif kind == 1 and len(y) > 1:
                    del y[at]
                else:
                    y.insert(at, g.integers(1, 1 << 63, dtype=np.uint64))
            pairs.append((x, np.array((y + [_PAD] * len(x))[: len(x)], np.uint64)))
    width = max(len(x) for x, _ in pairs)
    pad = lambda xs: np.array([np.concatenate([x, np.zeros(width - len(x), np.uint64)]) for x in xs])
    lengths = np.array([len(x) for x, _ in pairs])
    trial = np.zeros(len(pairs))
    for w in range(WALKS):
        walk = np.full(len(pairs), w, np.uint64)
        same = embed(pad([x for x, _ in pairs]), lengths, walk) == embed(pad([y for _, y in pairs]), lengths, walk)
        inside = np.arange(3 * width)[None, :] < 3 * lengths[:, None]
        trial += np.log1p(-np.minimum(((same & inside).sum(1) / (3 * lengths)) ** bits, 0.999999)) / WALKS
    r = WALKS
    while np.mean(1 - np.exp(r * trial)) < recall and r < 4096:
        r += WALKS
    return r


def edit_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least word edits of ``item`` to a run of ``text``, end of the first such run), by Myers' bit vectors."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text.tolist()):
        eq = masks.get(w, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        hp, hm = minus | ~(d0 | plus) & full, d0 & plus
        score += (1 if hp & top else 0) - (1 if hm & top else 0)
        hp, hm = hp << 1 & full, hm << 1 & full
        plus, minus = hm | ~(d0 | hp) & full, hp & d0
        if score < best:
            best, end = score, j + 1
    return best, end


@dataclass
class Index:
    """What the tasks need of a block of the benchmark."""

    ids: list
    items: list[np.ndarray]
    edits: list[int]
    places: np.ndarray

    def __post_init__(self):
        self.pieces: dict[int, tuple] = {}
        found: dict[int, list] = {}
        for i, (x, e) in enumerate(zip(self.items, self.edits)):
            cuts = np.linspace(0, len(x), e + 2).astype(int)
            for a, b in zip(cuts[:-1], cuts[1:]):
                found.setdefault(int(b - a), []).append((int(piece_hash(x[a:b], int(b - a))[0]), i, int(a)))
        for k, rows in found.items():
            rows.sort()
            h = np.array([r[0] for r in rows], np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[h >> np.uint64(44)] = True
            self.pieces[k] = (seen, h, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        self.width = max((len(x) for x in self.items), default=0)
        self.keys: dict[int, list[int]] = {}
        if self.items:
            keys = sample_keys(self._pad(self.items), np.array([len(x) for x in self.items]), self.places)
            for i, row in enumerate(keys.tolist()):
                for k in row:
                    self.keys.setdefault(k, []).append(i)
        self.known = np.array(sorted(self.keys), np.uint64)

    def _pad(self, xs: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(xs), self.width), np.uint64)
        for i, x in enumerate(xs):
            out[i, : len(x)] = x
        return out

    def windows(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(start, number of words) of the windows to test; ``rows``: where each document's words begin, and the end."""
        out = []
        for k, (seen, hashes, item, offset) in self.pieces.items():
            h = piece_hash(words, k)
            at = np.flatnonzero(seen[h >> np.uint64(44)])
            lo, hi = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            n = hi - lo
            j = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            size = np.array([len(x) for x in self.items])[item[j]]
            doc = np.searchsorted(rows, at, "right") - 1
            start = np.maximum(at - offset[j], rows[doc])  # a passage cut off by the document's start is tested there
            keep = at + k <= rows[doc + 1]  # a run over the end of a document is none
            out.append(np.stack([start, size, doc], 1)[keep])
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), int)

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, edits, first word, end word) of the nearest passage of every item found in a row."""
        for first, data, off in text_slices(column):
            words, rows = word_hashes(data, off)
            spots = self.windows(words, rows)
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for a in range(0, len(spots), 256):
                part = spots[a : a + 256]
                cut = [words[s : min(s + n, rows[d + 1])] for s, n, d in part.tolist()]
                keys = sample_keys(self._pad(cut), part[:, 1], self.places)
                met = np.isin(keys, self.known)
                for w in np.flatnonzero(met.any(1)).tolist():
                    s, n, d = part[w].tolist()
                    for i in {i for k in keys[w][met[w]].tolist() for i in self.keys[k] if len(self.items[i]) == n}:
                        e = self.edits[i]
                        lo, hi = max(int(rows[d]), s - e), min(int(rows[d + 1]), s + n + e)
                        edits, end = edit_match(self.items[i], words[lo:hi])
                        if edits <= e:
                            _, back = edit_match(self.items[i][::-1], words[lo : lo + end][::-1])
                            hit = (edits, lo + end - back - int(rows[d]), lo + end - int(rows[d]))
                            key = (first + d, i)
                            best[key] = min(best.get(key, hit), hit)
            yield from ((d, i, *hit) for (d, i), hit in sorted(best.items()))


def indexes(benchmark: DataFrame, max_edit: float = MAX_EDIT, min_words: int = MIN_WORDS, bits: int = BITS, recall: float = RECALL) -> Iterator[Index]:
    """The benchmark (item_id, text) in blocks of at most ``ITEMS`` items."""
    block: list[tuple] = []

    def made() -> Index:
        items = [x for _, x in block]
        reps = repetitions(items, max_edit, bits, recall)
        places = np.random.Generator(np.random.PCG64(99)).random((reps, bits))
        return Index([i for i, _ in block], items, [int(max_edit * len(x)) for x in items], places)

    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        words, _ = word_hashes(data, np.array([0, len(data)]))
        if len(words) >= min_words:
            block.append((r.item_id, words))
        if len(block) == ITEMS:
            yield made()
            block = []
    if block:
        yield made()


def contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """A row for each item found in a document: doc_id, item_id, edits, first_word, end_word (of the nearest passage)."""
    schema = "doc_id bigint, item_id bigint, edits bigint, first_word bigint, end_word bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark, **settings):

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, best = b.column(0).to_pylist(), {}
                for row, item, *hit in index.search(b.column(1)):
                    best[row, item] = min(best.get((row, item), hit), hit)
                rows = [(ids[r], index.ids[i], *h) for (r, i), h in best.items()]
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "edits", "first_word", "end_word"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(tidy(find), schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents that hold a passage of the benchmark. All columns stay."""
    for index in indexes(benchmark, **settings):
        docs = docs.where(arrow_column(_cleaner(index), "boolean")("text"))
    return docs


def _cleaner(index: Index):
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = np.ones(len(texts), bool)
            for row, *_ in index.search(texts):
                out[row] = False
            yield pa.array(out)

    return clean
