import random
import re

import numpy as np
import pytest

from portflow.llm import common as C
from portflow.llm import near_dedup as N


def brute(rows, k=2, threshold=80):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d is None, d or 0, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Über", "ça", "X y"]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 40, 80]))]
        rows.append((1000 - i, " ".join(words)))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = [w if rng.random() > 0.04 else rng.choice(vocabulary) for w in words]
            rows.append((rng.randrange(2000, 10**6), rng.choice([" ", "\n", "\t "]).join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
    base = [rng.choice(vocabulary) for _ in range(60)]
    for j in range(80):  # one star: near copies of a base, often not near each other
        words = list(base)
        for _ in range(3):
            words[rng.randrange(60)] = rng.choice(vocabulary)
        rows.append((3_000_000 + j, " ".join(words)))
    rows += [(4_000_000, " ".join(base))]
    rows += [(5_000_000 + j, "same text again and again") for j in range(50)]
    rows += [(None, "same text again and again"), (None, "alone without an id"), (7, None), (8, ""), (9, " \n\t"), (10, "one"), (11, "ONE"), (12, "two words"), (12, "two words"), (12, "other words here")]
    rows += [(13, "long " * 3 + " ".join(f"t{i}" for i in range(30_000))), (14, " ".join(f"t{i}" for i in range(30_000)))]
    return rows


@pytest.mark.parametrize("block", [512, 9])
def test_components_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", block)  # large buckets go in pairs of blocks
    rows = corpus(2)
    df = spark.createDataFrame([(d, t, 5, "r") for d, t in rows], "doc_id long, text string, cid long, root string").repartition(7)
    got = N.near_duplicates(df).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id or r.component_id is None) for r in got)
    assert N.near_duplicates(df.limit(0)).count() == 0
    only = N.near_duplicates(df.where("doc_id in (7, 8, 10)")).collect()
    assert sorted((r.doc_id, r.component_id) for r in only) == [(7, 7), (8, 8), (10, 10)]


def test_pipeline_form_keeps_one_of_each_group(spark):
    rows = [(i, f"a b c d e f g h {i % 3} " * 6) for i in range(30)] + [(99, None), (None, "x y z")]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, _gone string")
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "2", "99", "None"]


def test_pruning_bounds():
    need = C.least_matches(0.8, 256, 32, 0.001)
    assert list(need) == list(range(32, 257, 32)) and all(0.5 < m / n < 0.8 for n, m in need.items())
    g = np.random.default_rng(0)
    a = g.integers(0, 1 << 30, (4000, 256)).astype(np.uint32)
    missed = []
    for s in (0.8, 0.5):
        b = np.where(g.random(a.shape) < s, a, a + 1)
        missed.append(1 - len(N.prune(a, b, need)) / len(a))
    assert missed[0] < 0.01 and missed[1] > 0.99


def test_connected_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, j) for j in range(1000, 1400)] + [(5, 5), (1399, 2000)]
    got = dict(C.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[j] == 1 for j in [*range(1000, 1400), 2000]) and 5 not in got
    assert C.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_form_decides_on_rows(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    near = lambda w: text(w) + " more"
    rows = [
        (1, text("a")), (None, near("a")), (None, text("clean")), (None, None),  # a null-id copy beside a clean null-id text
        (2, text("b")), (3, near("b")), (3, text("other")),  # a repeated id with two texts, one a copy
        (4, text("c")), (4, text("c")), (4, text("c")), (5, near("c")),  # a repeated row
        (None, text("d")), (None, text("d")), (None, near("d")),  # copies without any id
        (6, text("e")), (6, near("e")),  # two near texts of one id
        (7, ""), (7, ""),
    ]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, _id string").repartition(5)
    got = N.drop_near_duplicates(df)
    assert got.columns == df.columns
    got = sorted(((str(r.doc_id), r.text or "") for r in got.collect()))
    loose = [r for r in got if r[1] in (text("d"), near("d"), text("e"), near("e"))]
    assert sorted(r[0] for r in loose) == ["6", "None"]
    assert [r for r in got if r not in loose] == sorted([
        ("1", text("a")), ("None", text("clean")), ("None", ""), ("2", text("b")), ("3", text("other")), ("4", text("c")), ("7", ""), ("7", ""),
    ])
