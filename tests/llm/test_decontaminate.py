import random

import numpy as np

from portflow.llm import decontaminate as D


def edit(rng, words, n):
    y = list(words)
    for _ in range(n):
        at = rng.randrange(len(y))
        kind = rng.randrange(3)
        if kind == 0:
            y[at] = f"new{rng.randrange(999)}"
        elif kind == 1 and len(y) > 1:
            del y[at]
        else:
            y.insert(at, f"in{rng.randrange(999)}")
    return y


def distance(item, text):
    """Least edits of item to a run of text (plain dynamic programming)."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_edit_match_equals_dynamic_programming():
    rng = random.Random(3)
    for _ in range(300):
        item = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 70))]
        text = [rng.randrange(1, 6) for _ in range(rng.randrange(0, 90))]
        got, end = D.edit_match(np.array(item, np.uint64), np.array(text, np.uint64))
        assert got == distance(item, text) == distance(item, text[:end])


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [draw(rng.choice([5, 6, 9, 14, 20, 33, 60])) for _ in range(40)]
    docs = []
    for i in range(260):
        words = draw(rng.choice([0, 3, 30, 200]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            it = rng.choice(items)
            at = rng.randrange(len(words) + 1)
            words[at:at] = edit(rng, it, rng.randrange(int(0.3 * len(it)) + 1))
        docs.append((i, " ".join(words)))
    docs += [(900, None), (901, ""), (None, " ".join(items[3])), (902, " ".join(items[2]).upper()), (902, "another row"), (903, "x " * 30_000 + " ".join(items[5]))]
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(100, None), (101, ""), (102, "w1 w2"), (103, " ".join(items[0])), (None, " ".join(items[1]))]
    return docs, bench


def test_matches_brute_force(spark):
    docs, bench = corpus(1)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int").repartition(4)
    b = spark.createDataFrame([(i, t, "x") for i, t in bench], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r.edits for r in D.contaminated(d, b).collect()}
    want = {}
    for i, t in docs:
        words = (t or "").lower().split()
        for j, x in bench:
            x = (x or "").split()
            if len(x) >= 5:
                e = distance(x, words)
                if e <= int(0.2 * len(x)):
                    want[i, j] = min(e, want.get((i, j), e))
    missed = want.keys() - got.keys()
    assert not got.keys() - want.keys()
    assert len(missed) <= 0.01 * len(want)
    assert all(got[k] == want[k] for k in got)
    left = D.drop_contaminated(d, b)
    assert left.columns == d.columns
    bad = {i for i, _ in got}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, t in docs if i not in bad or (t == "another row"))
    assert D.contaminated(d, b.limit(0)).count() == 0 and D.contaminated(d.limit(0), b).count() == 0
    assert D.drop_contaminated(d, b.limit(0)).count() == d.count()


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    docs, bench = corpus(7)
    d = spark.createDataFrame(docs[:80], "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    one = sorted(map(str, D.contaminated(d, b).collect()))
    monkeypatch.setattr(D, "ITEMS", 9)
    assert len(set(one) ^ set(map(str, D.contaminated(d, b).collect()))) <= 1


def test_column_steps_of_the_pipeline_need_no_pandas_and_give_memory_back(spark, monkeypatch):
    import subprocess
    import sys

    import pyarrow as pa

    from portflow.llm import common as C
    from portflow.llm import toxicity as T

    index = next(D.indexes(spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")))
    model = T.Model({"idiot": 3.0}, {}, [-2.0, 1.0, 1.0, 1.0])
    texts = pa.array(["x one two three four five six y", None, "", "you idiot"])
    freed = []
    monkeypatch.setattr(C, "_release", lambda: freed.append(1))
    for made, kind, want in ((D._cleaner(index), "boolean", [False, True, True, True]), (T._scorer(model), "double", None)):
        out = [x for a in C.arrow_column(made, kind).func(iter([texts, texts])) for x in a.to_pylist()]
        assert len(out) == 8 and out[:4] == out[4:] and (want is None or out[:4] == want)
    assert len(freed) == 2  # once a task
    code = "import sys, portflow.llm.decontaminate, portflow.llm.line_dedup, portflow.llm.toxicity; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
