import math

import numpy as np

from portflow.llm import inner_search as S


def brute(rows, k, is_query):
    """Sorted (query_id, rank, vec_id, score) of rows (vec_id, embedding), in whole numbers."""
    items = []
    for i, v in rows:
        if i is not None and v is not None and not any(x is None or not math.isfinite(x) or not math.isfinite(x * 1024) for x in v):
            items.append((i, [math.floor(x * 1024) for x in v]))
    out = []
    for n, (q, x) in enumerate(items):
        if is_query(q):
            found = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), i) for m, (i, y) in enumerate(items) if m != n and len(x) == len(y)]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(found, key=lambda f: (-f[0], f[1]))[:k])]
    return sorted(out)


def check(spark, rows, k=10, every=7, kind="double"):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, row int, block int").repartition(5)
    got = S.top_inner_products(df, f"vec_id % {every} = 0", k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = brute(rows, k, lambda q: q % every == 0)
    assert sorted(map(tuple, got.collect())) == want
    return want


def test_lengths_ties_copies_and_dimensions(spark, monkeypatch):
    monkeypatch.setattr(S, "BASE", 64)
    monkeypatch.setattr(S, "QUERIES", 16)
    g = np.random.default_rng(5)
    rows = [(i, (g.normal(size=12) * 10.0 ** g.uniform(-2, 2)).tolist()) for i in range(500)]
    rows += [(600 + i, rows[9][1]) for i in range(200)]  # one very common vector: ties
    rows += [rows[14]] * 3 + [(21, rows[3][1])]  # repeated rows, among them a query; one vec_id with two vectors
    rows += [(1001, [0.25] * 3), (1008, [0.5, -0.5, 0.1]), (1015, [3.0]), (1022, []), (1023, []), (1029, [0.0] * 12)]
    assert check(spark, rows)


def test_left_out_and_very_large(spark):
    g = np.random.default_rng(6)
    rows = [(i, (g.normal(size=8) * (1e6 if i % 3 else 1)).tolist()) for i in range(60)]
    rows += [(70, None), (77, [None] * 8), (84, [1.0] * 7 + [float("nan")]), (91, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    rows += [(98, [1e300] * 8), (105, [-1e300, 1e300] + [0.0] * 6), (112, [1e308] * 8), (119, [1e9] * 8), (126, [1e12] * 8), (133, [-3.00048828125] * 8)]
    check(spark, rows)
    check(spark, [])
    check(spark, [(1, [1.0, 2.0]), (7, [0.5, 0.5])])  # fewer candidates than k


def test_spread_that_the_rotation_finds(spark, monkeypatch):
    monkeypatch.setattr(S, "BASE", 256)
    g = np.random.default_rng(7)
    turn = np.linalg.qr(g.normal(size=(32, 32)))[0]
    x = ((g.normal(size=(1500, 32)) * 0.5 ** np.arange(32)) @ turn).astype(np.float32)
    seen = []
    real = S.alive

    def counted(q, b, k, floor):
        for i, j in real(q, b, k, floor):
            seen.append(len(j))
            yield i, j

    check(spark, [(i, v.tolist()) for i, v in enumerate(x)], every=50, kind="float")
    # the same tiles, outside Spark: nearly all pairs are dropped before they are scored
    codes = np.floor(x.astype(float) * 1024)
    order = np.argsort(-np.linalg.norm(codes, axis=1), kind="stable")
    basis = np.linalg.svd(codes, full_matrices=False)[2][:24].T

    def block(at):
        c = codes[at]
        front, whole = c @ basis, (c * c).sum(1)
        done = np.cumsum(front * front, 1)
        rests = np.array([np.sqrt(np.maximum(whole - done[:, n - 1], 0)) + 1e-6 * np.sqrt(whole) for n in S.cuts(32)])
        return S.Block({"dim": 32, "block": 0, "longest": float(np.sqrt(whole).max()), "ids": at.astype(np.int64).tobytes(), "rows": at.astype(np.int64).tobytes(), "kind": 2, "codes": c.tobytes(), "lengths": np.sqrt(whole).tobytes(), "front": front.astype(np.float32).tobytes(), "rests": rests.tobytes()})

    q, floor = block(np.arange(0, 1500, 50)), np.full(30, -np.inf)
    for a in range(0, 1500, 256):
        list(counted(q, block(order[a : a + 256]), 10, floor))
    assert sum(seen) < 0.1 * 30 * 1500


def test_bounds_never_drop_a_better_pair():
    g = np.random.default_rng(8)
    for _ in range(20):
        x = g.integers(-1000, 1000, (60, 20)).astype(float)
        whole = (x * x).sum(1)
        done = np.cumsum(x * x, 1)
        rests = np.array([np.sqrt(np.maximum(whole - done[:, c - 1], 0)) + 1e-6 * np.sqrt(whole) for c in S.cuts(20)])
        b = S.Block({"dim": 20, "block": 0, "longest": 1.0, "ids": np.arange(60).tobytes(), "rows": np.arange(60).tobytes(), "kind": 2, "codes": x.tobytes(), "lengths": np.sqrt(whole).tobytes(), "front": x[:, :15].astype(np.float32).tobytes(), "rests": rests.tobytes()})
        all_scores = x @ x.T
        np.fill_diagonal(all_scores, -np.inf)
        floor = np.partition(all_scores, -5, axis=1)[:, -5].copy()
        found = dict(S.alive(b, b, 5, floor))
        for i in range(60):
            assert set(np.flatnonzero(all_scores[i] >= floor[i])) <= set(found[i])
