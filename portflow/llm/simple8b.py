"""Token ids as Simple-8b blocks: word-aligned packing with selectors, escapes and block offsets.

A 64-bit word holds a 4-bit selector and 60 bits of payload: the selector says how many values of which width follow,
so common small ids share a word. Selector 14 is the escape for a value of more than 60 bits: the next word holds it
raw. A block is: magic ``S8B1``, number of documents, ids and words (unsigned 64-bit), ids of each document (unsigned
32-bit), and for every ``MINI`` words the ids before them (unsigned 32-bit), then the words; all little-endian. The
mini-block offsets let a reader decode any part of a block; each selector's words are decoded together by numpy.

Files: a Parquet table with one row a block (shard, block, ids of the shard before it, ids in it, document ids,
the block's bytes). Shards are ranges of doc_id in ascending order and blocks ascend within them.

Edge cases: a null text is empty and has the end id only; null doc_ids come first; rows that repeat a doc_id stay
rows of their own; an empty table gives an empty file set and no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy
from .tokens import default_vocabulary, encoder

# Fixed values of the code: selector -> (values in a word, bits of each).
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 14
MAGIC = b"S8B1\0\0\0\0"
MINI = 1024
BLOCK_IDS = 1 << 17
_HALF_BITS = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _bits(v: np.ndarray) -> np.ndarray:
    out = _HALF_BITS[v & np.uint64(0xFFFF)]
    for k in (16, 32, 48):
        if len(v) and int(v.max()) >> k:
            part = (v >> np.uint64(k)) & np.uint64(0xFFFF)
            out = np.where(part > 0, _HALF_BITS[part] + np.uint8(k), out)
    return out


def pack(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Simple-8b words, the fullest selector first at every place."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    v = np.concatenate([values.astype(np.uint64), np.zeros(60, np.uint64)])
    widest = {1: _bits(v)}
    for a, c in ((1, 2), (2, 3), (2, 4), (4, 5), (4, 6), (4, 7), (4, 8), (8, 10), (8, 12), (8, 15), (10, 20), (15, 30), (30, 60)):
        m = widest[a]
        shift = c - a
        widest[c] = np.maximum(m[: len(m) - shift], m[shift:])  # the largest of c values from each place
    sel = np.where(widest[1][:n] > 60, np.uint8(ESCAPE), np.uint8(13))
    for s in range(12, -1, -1):
        c, w = SELECTORS[s]
        sel[widest[c][:n] <= w] = s
    step = np.array([c for c, _ in SELECTORS] + [1], np.int64)[sel].tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += step[i]
    pos = np.array(at, np.int64)
    sel = sel[pos]
    place = np.arange(len(pos)) + np.concatenate([[0], np.cumsum(sel == ESCAPE)[:-1]])
    out = np.zeros(len(pos) + int((sel == ESCAPE).sum()), np.uint64)
    for s, (c, w) in enumerate(SELECTORS):
        k = np.flatnonzero(sel == s)
        if len(k):
            word = np.full(len(k), s << 60, np.uint64)
            for j in range(c):
                word |= v[pos[k] + j] << np.uint64(j * w)
            out[place[k]] = word
    k = np.flatnonzero(sel == ESCAPE)
    out[place[k]] = np.uint64(ESCAPE << 60)
    out[place[k] + 1] = v[pos[k]]
    return out


def _layout(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(selectors, values each word holds); a raw word after an escape has selector 15 and holds one."""
    sel = (words >> np.uint64(60)).astype(np.uint8)
    esc = np.flatnonzero(sel == ESCAPE)
    raw_at = -1
    for e in esc.tolist():
        if e != raw_at:
            raw_at = e + 1
            sel[raw_at] = 15
    return sel, np.array([c for c, _ in SELECTORS] + [0, 1], np.int64)[sel]


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of Simple-8b words."""
    sel, count = _layout(words)
    start = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(start[-1]), np.uint64)
    for s, (c, w) in enumerate(SELECTORS):
        k = np.flatnonzero(sel == s)
        mask = np.uint64((1 << w) - 1)
        for j in range(c if len(k) else 0):
            out[start[k] + j] = (words[k] >> np.uint64(j * w)) & mask
    raw = np.flatnonzero(sel == 15)
    out[start[raw]] = words[raw]
    return out[:n]


def write_block(docs: list[bytes]) -> bytes:
    """One block from documents' ids (each little-endian unsigned 32-bit)."""
    lengths = np.array([len(d) // 4 for d in docs], "<u4")
    words = pack(np.frombuffer(b"".join(docs), "<u4").astype(np.uint64))
    _, count = _layout(words)
    mini = np.concatenate([[0], np.cumsum(count)])[: len(words) : MINI].astype("<u4")
    head = np.array([len(docs), int(lengths.sum()), len(words)], "<u8")
    return b"".join([MAGIC, head.tobytes(), lengths.tobytes(), mini.tobytes(), words.astype("<u8").tobytes()])


def read_block(block: bytes) -> list[bytes]:
    """Documents' ids of a block, as ``write_block`` got them."""
    if block[:8] != MAGIC:
        raise ValueError("not a Simple-8b block")
    n_docs, n_ids, n_words = np.frombuffer(block, "<u8", 3, 8).tolist()
    lengths = np.frombuffer(block, "<u4", n_docs, 32)
    at = 32 + 4 * n_docs + 4 * -(-n_words // MINI)
    ids = unpack(np.frombuffer(block[at:], "<u8", n_words), n_ids).astype("<u4")
    ends = np.cumsum(lengths, dtype=np.int64)
    return [ids[e - k : e].tobytes() for e, k in zip(ends.tolist(), lengths.tolist())]


_FILE = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("bytes", pa.binary())])
_FILE_SQL = "shard int, block int, ids_before bigint, n_ids bigint, doc_ids array<bigint>, bytes binary"
_READ = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_READ_SQL = "doc_id bigint, shard int, start bigint, n_tokens bigint, ids_crc32 bigint"


def write_ids(docs: DataFrame, name: str = "token-ids", vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the files; returns them as read back (a row a block)."""
    path = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(path).encode, TaskContext.get().partitionId()
        ids, docs, held, before, k = [], [], 0, 0, 0

        def row():
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": k, "ids_before": before, "n_ids": held, "doc_ids": ids, "bytes": write_block(docs)}], _FILE)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                docs.append(enc(t.as_py()) + end)
                held += len(docs[-1]) // 4
                if held >= BLOCK_IDS:
                    yield row()
                    before, k, ids, docs, held = before + held, k + 1, [], [], 0
        if docs:
            yield row()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return stored(ordered.mapInArrow(tidy(blocks, encodes=True), _FILE_SQL), name)


def read_ids(files: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; from the files alone."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, before, doc_ids, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                ids = read_block(block.as_py())
                n = np.array([len(x) // 4 for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([shard] * len(ids), pa.int32()), pa.array(before + np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x) for x in ids], pa.int64())], schema=_READ)

    docs = files.select("shard", "ids_before", "doc_ids", "bytes").mapInArrow(tidy(decode), _READ_SQL)
    # one row a shard: as many rows as the write had tasks
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    prior = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("prior"))
    return docs.join(prior, "shard").select("doc_id", (F.col("start") + F.col("prior")).alias("start"), "n_tokens", "ids_crc32")

