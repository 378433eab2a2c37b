import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from portflow.llm import repeats as R


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[a : a + length] for _, t in texts for a in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - length + 1):
            if count[t[a : a + length]] > 1:
                gone[a : a + length] = True
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    letters = "ab cdeéä漢\n"
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [draw(rng.choice([20, 39, 40, 41, 60, 100, 160])) for _ in range(12)]
    rows = []
    for i in range(160):
        parts = [draw(rng.choice([0, 5, 50, 120]))]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                a = rng.randrange(len(p))
                p = p[: a] + draw(1) + p[a + 1 :]
            parts += [p, draw(rng.choice([0, 3, 80]))]
        rows.append((i, "".join(parts)))
    base = draw(300)
    for j in range(40):  # near copies of one text
        b = list(base)
        for _ in range(2):
            b[rng.randrange(300)] = draw(1)
        rows.append((1000 + j, "".join(b)))
    rows += [(2000 + j, base) for j in range(20)]
    rows += [(3000, None), (3001, ""), (3002, "ab" * 300), (3003, "a" * 39), (3004, "a" * 40), (3005, "a" * 41 + draw(30)), (3006, "xyz" * 12 + "q"), (None, passages[3] + draw(30)), (None, base), (3007, rows[4][1]), (3007, rows[5][1]), (3008, draw(50)), (3008, draw(50)), (3009, (draw(35) + "\n") * 30)]
    return rows


@pytest.mark.parametrize("most", [10_000, 12, 2])
def test_matches_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(R, "BATCH", 50)
    rows = corpus(most)
    df = spark.createDataFrame([(i, t, 1, "m") for i, t in rows], "doc_id long, text string, x int, m string").repartition(5)
    got = R.remove_repeats(df, length=40, gram=12, most=most)
    res = got.collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in res), key=str) == brute(rows, 40)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in res)
    assert R.remove_repeats(df.limit(0)).count() == 0


def test_production_lengths(spark):
    rng = random.Random(9)
    draw = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p = [draw(399), draw(400), draw(401), draw(900)]
    rows = [(i, draw(rng.randrange(700)) + rng.choice(p) + draw(rng.randrange(700))) for i in range(30)] + [(99, p[3]), (100, p[3][:650])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in R.remove_repeats(df).drop("kept").collect()]
    assert sorted(got, key=str) == brute(rows, 400)


@pytest.mark.parametrize("broken", [False, True])
def test_suffix_order_is_that_of_the_bytes(broken, monkeypatch):
    if broken:  # hashes that collide for many bytes: the verification must notice
        monkeypatch.setattr(R.C, "_BYTE", np.arange(256, dtype=np.uint64) % np.uint64(2))
    rng = random.Random(4)
    group = np.sort(np.array([rng.randrange(9) for _ in range(400)]))
    rows = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 3, 10, 30]))) for _ in range(400)]
    text = np.zeros((400, 30), np.uint8)
    for i, r in enumerate(rows):
        text[i, : len(r)] = list(r)
    s = R.Suffixes(text, np.array([len(r) for r in rows]), group)
    assert [(group[i], rows[i]) for i in s.order] == sorted(zip(group, rows))
    for k in (0, 1, 5, 30):
        c = s.classes(k)
        for i in range(0, 400, 7):
            for j in range(i):
                if len(rows[i]) >= k and len(rows[j]) >= k:
                    assert (c[i] == c[j]) == (group[i] == group[j] and rows[i][:k] == rows[j][:k])


def test_one_group_of_many_contexts(spark):
    """20,000 texts share a passage between words of their own; some are cut within it, some share a side as well."""
    rng = random.Random(21)
    draw = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    p, sides = draw(47), [draw(20) for _ in range(5)]
    rows = []
    for i in range(20_000):
        left = rng.choice(sides) if i % 7 == 0 else draw(rng.randrange(12, 30))
        right = rng.choice(sides) if i % 11 == 0 else draw(rng.randrange(12, 30))
        a, b = (rng.randrange(10), 47) if i % 13 == 0 else (0, 47 - rng.randrange(10)) if i % 17 == 0 else (0, 47)
        rows.append((i, left + p[a:b] + right))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = [tuple(r) for r in R.remove_repeats(df, length=40, gram=12).drop("kept").collect()]
    assert sorted(got, key=str) == brute(rows, 40)
