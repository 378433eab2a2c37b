import numpy as np
from pyspark.sql import functions as F

from portflow.llm import neighbours as N


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = {}
    for q, vs in ok.items():
        if q % 20 == 0:
            for x in vs:
                c = sorted((-float(np.dot(x, y)), i) for i, ys in ok.items() if i != q for y in ys if len(y) == len(x))
                out[q] = c[:k]
    return out


def test_exact_on_awkward_vectors(spark, monkeypatch):
    monkeypatch.setattr(N, "BASE", 64)
    monkeypatch.setattr(N, "QUERIES", 8)
    monkeypatch.setattr(N, "GROUP", 3)
    g = np.random.default_rng(2)
    rows = [(i, (g.normal(size=24) * 10.0 ** g.integers(-3, 4)).tolist()) for i in range(900)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)]  # one very common vector
    rows += [(3000, None), (3020, []), (3040, [0.0] * 24), (3060, [1.0, None] + [0.0] * 22), (3080, [float("nan")] * 24), (3100, [float("inf")] + [0.0] * 23), (None, rows[0][1]), (3120, [1.0, 2.0]), (3121, [1.0, 1.0]), (3140, [1e-30] * 24)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, dim int").repartition(6)
    got = {}
    for r in N.nearest(df.where("vec_id % 20 = 0"), df, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = {q: c for q, c in brute(rows, 20).items() if c}
    assert got.keys() == want.keys()
    for q, c in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, len(c) + 1))
        assert [m[1] for m in mine] == [i for _, i in c]
        assert np.allclose([m[2] for m in mine], [-s for s, _ in c], rtol=1e-12)
    assert N.nearest(df.limit(0), df).count() == 0 and N.nearest(df, df.limit(0)).count() == 0


def test_bounds_hold():
    g = np.random.default_rng(1)
    x, y = (N.Block(np.arange(200).tobytes(), g.normal(size=(200, 40)).astype(np.float32).tobytes(), 40) for _ in range(2))
    near = (x.codes @ y.codes.T) * x.scale[:, None] * y.scale[None, :]
    slack = x.norm[:, None] * y.loss[None, :] + x.loss[:, None] * (y.norm + y.loss)[None, :]
    assert (np.abs(near - x.x @ y.x.T) <= slack + 1e-9).all()


def test_given_table_against_double_precision(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = N.nearest(df.where(F.col("vec_id") % 20 == 0), df)
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 20)
    assert {(r.query_id, r.vec_id) for r in got.collect()} == {(q, i) for q, c in want.items() for _, i in c}
