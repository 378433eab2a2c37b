import re
from collections import Counter, defaultdict

from portflow.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def brute(rows):
    """lang, source, part, item, value, rank of rows (text, lang, source), by the definition."""
    docs = [(x or "", lang or "", source or "") for x, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        df, groups, whole = Counter(), defaultdict(Counter), Counter()
        for text, at, source in docs:
            if at == lang:
                found = Counter(TERM.findall(text.translate(LOWER)))
                df.update(found.keys())
                groups[source] += found
        kept = sorted(t for t, n in df.items() if n >= 3)
        for c in groups.values():
            whole.update(c)

        def p(counts):
            total = sum(counts[t] for t in kept)
            return [1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept]

        q, ps = p(whole), {s: p(c) for s, c in groups.items()}
        for s, mine in ps.items():
            pair = sorted((-sum((x - y) ** 2 // y for x, y in zip(mine, other)), o.encode(), o) for o, other in ps.items() if o != s)
            term = sorted((-((x - y) ** 2 // y), t.encode(), t) for x, y, t in zip(mine, q, kept) if groups[s][t] and x > y)[:200]
            for part, found in (("pair", pair), ("term", term)):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame([(1, t, lang, s, 7) for t, lang, s in rows], "doc_id long, text string, lang string, source string, term long").repartition(3)
    got = D.source_divergence(df)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute(rows)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "ENTRIES", 5)
    monkeypatch.setattr(D, "PIECE", 64)
    rows = [("The cat, the CAT; éÉ über naïve", "en", "a"), ("the cat and 猫猫 dog", "en", "b"), ("THE dog the-dog 猫猫 cat", "en", "a"), ("the 猫猫 dog dog", "en", "c")]
    rows += [(None, "en", "d"), ("", "en", None), ("12 34 !", "fr", "a"), ("seul", "fr", "b"), ("mot mot", None, "a"), ("mot", None, None), ("mot autre", None, "a")]
    rows += [("word " * 900 + "x" * 300 + " tail\ttail\ntail", "en", "hot")] * 5  # copies, and a long text
    rows += [("alone", "xx", "a")] * 3 + [("same same", "de", s) for s in "abc" for _ in range(3)]  # an only source; ties
    check(spark, rows)


def test_many_terms_and_a_hot_source(spark):
    import random

    g = random.Random(3)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(900)]
    rows = [(" ".join(g.choices(vocabulary, k=g.randrange(60))), "en" if g.random() < 0.9 else "de", g.choice(["hot"] * 5 + [f"s{i}" for i in range(9)])) for _ in range(300)]
    check(spark, rows)


def test_empty_table(spark):
    check(spark, [])


def test_a_path_is_walked_once_a_node_and_ancestor(spark):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("number", pa.int32()), ("p", pa.int64()), ("z", pa.int64())]))
    path = lambda *x: [{"number": i, "p": p, "z": 2} for i, p in x]
    paths = [path((0, 5), (1, 7)), path((0, 5), (1, 7), (2, 9)), path((0, 5), (2, 9)), path((0, 6), (1, 7))]
    batch = pa.record_batch([pa.array(["x"] * 4), pa.array(paths, kind), pa.array([3, 1, 2, 1])], names=["lang", "path", "many"])
    f = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for row, n in zip(paths, [3, 1, 2, 1]):
        for a in row:
            for b in row:
                if a is not b:
                    want[a["number"], b["number"]] += n * (f(a["p"], b["p"]) - f(a["p"], 2) - f(2, b["p"]) + f(2, 2))
    got = Counter()
    for b in D.corrections(iter([batch])):
        for _, x, y, hi, lo in zip(*(c.to_pylist() for c in b.columns)):
            got[x, y] += (hi << 32) + lo
    assert got == want
