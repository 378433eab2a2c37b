import zlib
from collections import defaultdict

import numpy as np

from portflow.llm import packing as P
from portflow.llm.tokens import default_vocabulary, encoder


def check(df, docs, window):
    enc = encoder(default_vocabulary()).encode
    want = sorted((i is None, i or 0, np.frombuffer(enc(t), "<u4").tolist() + [0]) for i, t in docs)
    pieces = defaultdict(list)
    seqs = defaultdict(list)
    got = df.collect()
    for r in got:
        pieces[(r.doc_id, r.doc_tokens)].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for spans in seqs.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at and n > 0
            at += n
        assert at <= window
    assert sorted(seqs) == list(range(len(seqs)))
    total = sum(len(d[2]) for d in want)
    assert sum(r.length for r in got) == total
    assert len(seqs) * window - total < window  # only the last window is padded
    for none, i, ids in want:
        own = pieces[(None if none else i, len(ids))]
        by = defaultdict(list)
        for r in own:
            by[r.start].append(r)
        at = 0
        while at < len(ids):
            r = by[at][0]
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert any(zlib.crc32(part) == x.ids_crc32 and x.length == r.length for x in by[at]) or len(by[at]) > 1
            at += r.length
        assert at == len(ids)


def test_pack_all_documents(spark):
    g = np.random.default_rng(3)
    docs = [(i, " ".join(g.choice(["the", "cat", "läuft", "x9", "\n"], int(g.integers(0, 90))))) for i in range(600)]
    docs += [(1000, None), (1001, ""), (None, "no id"), (5, "twice"), (2000, "long " * 700)]
    df = spark.createDataFrame([(i, t, "s", 7) for i, t in docs], "doc_id long, text string, length string, row int").repartition(5)
    check(P.pack(df, window=64), docs, 64)
    assert P.pack(df.limit(0)).count() == 0


def test_plan_stays_within_the_histogram():
    g = np.random.default_rng(1)
    h = np.zeros(64, np.int64)
    h[1:] = g.integers(0, 50, 63)
    combos, repeats = P.plan(h, 64)
    assert (combos.sum(1) == 64).all()
    used = np.zeros(64, np.int64)
    for c, r in zip(combos, repeats):
        for v in c[c > 0]:
            used[v] += r
    assert (used <= h).all()
    assert used @ np.arange(64) > 0.6 * (h @ np.arange(64))
    assert len(P.plan(np.zeros(64, np.int64), 64)[1]) == 0


def test_nnls_meets_the_optimality_conditions():
    combos = np.array([[0, 1, 3], [0, 2, 2], [1, 1, 2], [0, 3, 1]])
    h = np.array([0, 5000, 9000, 1000])
    x = P.nnls(combos, h, sweeps=4000)
    a = np.array([[np.count_nonzero(c == v) for c in combos] for v in (1, 2, 3)], float)
    gradient = a.T @ (h[1:] - a @ x)
    assert (x >= 0).all() and (gradient < 10).all() and (np.abs(gradient[x > 1]) < 10).all()


def test_ids_can_be_read_from_the_result(spark):
    enc = encoder(default_vocabulary()).encode
    docs = [(i, f"cat läuft {i} " * (i % 40)) for i in range(200)] + [(2000, "long " * 700), (2001, None)]
    pieces = P.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), window=64).localCheckpoint()
    by = defaultdict(dict)
    for r in pieces.collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        by[r.doc_id][r.start] = bytes(r.ids)
    end = np.array([0], "<u4").tobytes()
    assert {i: b"".join(x for _, x in sorted(p.items())) for i, p in by.items()} == {i: enc(t) + end for i, t in docs}
    seqs = P.sequences(pieces).collect()
    assert sorted(s.sequence_id for s in seqs) == list(range(len(seqs)))
    for s in seqs:
        assert len(s.ids) == 4 * s.n_ids <= 4 * 64
        for p in s.parts:
            assert s.ids[4 * p.offset : 4 * (p.offset + p.length)] == by[p.doc_id][p.start]


def test_a_worker_remembers_the_pieces_of_a_long_corpus():
    from types import SimpleNamespace

    from portflow.llm.tokens import _Memo

    merged = []
    get = _Memo(lambda piece: merged.append(piece) or [SimpleNamespace(id=1)], P.MEMO).__getitem__
    pieces = [f" p{i}" for i in range(300_000)]
    for p in [*pieces, *pieces]:
        get(p)
    assert len(merged) == len(pieces)  # none is merged again
