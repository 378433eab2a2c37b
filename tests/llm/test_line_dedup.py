import random

import numpy as np
import pytest

from portflow.llm import line_dedup as L

WS = " \t\n\r\x0b\x0c"


def brute(rows, k=8, threshold=80):
    lines = []
    for d, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            x = x.strip(WS)
            if x:
                lines.append((d, n, x, {x[i : i + k] for i in range(max(1, len(x) - k + 1))}))
    texts = sorted({x for _, _, x, _ in lines})
    sets = {x: s for _, _, x, s in lines}
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(texts):
        for y in texts[:i]:
            both = len(sets[x] & sets[y])
            if 100 * both >= threshold * (len(sets[x]) + len(sets[y]) - both):
                root[find(x)] = find(y)
    group = {}
    for d, n, x, _ in lines:
        group.setdefault(find(x), []).append((d is None, d or 0, n))
    out = []
    for members in group.values():
        if len(members) > 1:
            out += [(m, min(members)) for m in members]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnoprstuvwzäßéñ漢"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))
    base = [" ".join(word() for _ in range(rng.choice([1, 2, 6, 15, 25, 28, 60, 150]))) for _ in range(60)]

    def edit(x):
        x = list(x)
        for _ in range(rng.choice([0, 1, 1, 2])):
            x[rng.randrange(len(x))] = rng.choice(letters)
        return rng.choice(["", " ", "\t"]) + "".join(x) + rng.choice(["", "  ", "\r"])

    rows = [(i, "\n".join(rng.choice([word() + " " + word(), "", edit(rng.choice(base)), edit(rng.choice(base))]) for _ in range(rng.randrange(8)))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, "\n \n"), (None, base[3]), (None, "only here, without an id"), (203, "x"), (204, "x\nx"), (205, base[7] + "\n"), (205, "another text"), (206, "z" * 30_000 + " end of a long line"), (207, "z" * 30_000 + " end of a long line")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, keys string, cid int").repartition(5)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.line_no), (r.keep_doc_id is None, r.keep_doc_id or 0, r.keep_line_no)) for r in L.fuzzy_lines(df).collect())
    want = brute(rows)
    assert set(got) <= set(want)
    assert len(set(want) - set(got)) <= 0.02 * len(want)  # the stated miss probability of banding
    assert L.fuzzy_lines(df.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    for n in (60, 140, 150, 400):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        hits = {"minima": [], "binned": []}
        for _ in range(200):
            h = rng.permutation(np.unique(rng.integers(0, 1 << 63, n + n // 8, dtype=np.uint64)))[: n + n // 8]
            x, y = h[: n], h[n // 8 :]
            both, at = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
            want = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            for name, f in (("minima", L._minima), ("binned", L._binned)):
                s = f(both, at, 40)
                hits[name].append((s[0] == s[1]).mean() - want)
        assert abs(np.mean(hits["minima"])) < 0.03 and abs(np.mean(hits["binned"])) < 0.04
    del a


def test_pipeline_form(spark):
    rows = [
        (1, "this is the first line of all\nown text of the first document", 9),
        (2, "This is another document\nthis is the first line of all", 9),
        (3, "this is the first line of all", 9),
        (4, None, 0), (5, "", 0), (6, " \n", 2),
        (6, "this is the first line of all\nanother text for the same id", 5),
        (None, "this is the first line of all\nno id, other text, still kept here", 3),
    ]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, n_chars long, _lines string").select("doc_id", "text", F_lang(), "n_chars")
    out = L.drop_repeated_lines(df)
    assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    got = sorted((str(r.doc_id), r.text, r.n_chars) for r in out.collect())
    assert got == sorted([
        ("1", rows[0][1], 9), ("2", "This is another document", 24), ("4", None, 0), ("5", "", 0), ("6", " \n", 2),
        ("6", "another text for the same id", 28), ("None", "no id, other text, still kept here", 34),
    ])


def test_repeated_rows_and_clashing_columns(spark):
    """One of fully repeated rows keeps a line, with an id or without; two texts of one id are rows of their own."""
    line = "a line that stands in many rows here"
    rows = [(1, line), (1, line), (1, line), (2, f"{line}\nown words of the second"), (2, f"{line}\nquite different words of it"),
            (None, "nobody knows whose line this is"), (None, "nobody knows whose line this is"), (None, "nobody knows whose line this is\nand another thing"),
            (3, None), (3, None), (4, ""), (4, ""), (None, None)]
    names = ["_id", "_hash", "_lines", "line_doc_id", "Line_Text_Hash", "lines_gone", "twin", "i", "h", "n"]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names)).repartition(4)
    out = L.drop_repeated_lines(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, line), (2, "own words of the second"), (2, "quite different words of it"), (None, "nobody knows whose line this is"),
                          (None, "and another thing"), (3, None), (3, None), (4, ""), (4, ""), (None, None)], key=str)
    assert all(tuple(r[n] for n in names) == tuple(range(len(names))) for r in out.collect())


def F_lang():
    from pyspark.sql import functions as F

    return F.lit("en").alias("lang")


def test_lines_that_repeat_themselves(spark):
    """Lengths of 100, 200 and 1,000 characters: equal or nearly equal sets, whatever the number of positions."""
    rows, i = [], 0
    for unit in ("-", "=-", "word ", "buy now! ", "läuft weiter und weiter "):
        for n in (100, 200, 1000):
            rows.append((i, "own line %d %s\n" % (i, chr(97 + i) * 3) + (unit * n)[:n]))
            i += 1
    rng = np.random.default_rng(5)
    for n in (100, 131, 170, 400):  # lines that do not repeat themselves, and the same ones twice over
        line = "".join(chr(97 + c) for c in rng.integers(0, 26, n))
        rows += [(i, line), (i + 1, line + line)]
        i += 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {((r.doc_id is None, r.doc_id or 0, r.line_no), (r.keep_doc_id is None, r.keep_doc_id or 0, r.keep_line_no)) for r in L.fuzzy_lines(df).collect()}
    assert got == set(brute(rows))
    assert {((False, d, 1), (False, d // 3 * 3, 1)) for d in range(15)} <= got


def test_sets_and_minima_of_many_lines_at_once(monkeypatch):
    import portflow.llm.common as C
    import portflow.llm.line_dedup as L

    lines = [b"short", b"q" * 40, b"the same words, the same words", "äöü ßßß".encode(), b"x" * 8, b"the same words, the other words", b"short"]

    def own(line):
        s = L.Slice(np.frombuffer(line, np.uint8), np.array([0, len(line)]))
        return np.unique(s.shingles(8, np.arange(1))[0])

    unique = np.unique
    want = [own(x) for x in lines]
    calls = []
    monkeypatch.setattr(np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    got = L.line_sets(lines, 8)
    assert len(calls) <= 1  # none a line
    monkeypatch.undo()
    assert len(got) == len(want) and all(np.array_equal(x, y) for x, y in zip(got, want))
    for x in [*got, got[0][:0]]:
        for y in [*got, got[0][:0]]:
            assert C.common(x, y) == len(set(x.tolist()) & set(y.tolist()))
    h, at = np.concatenate(got), np.concatenate([[0], np.cumsum([len(x) for x in got])])
    whole = L._minima(h, at, 12)
    for block in (1, 7, 30):
        monkeypatch.setattr(L, "BLOCK", block)
        assert np.array_equal(L._minima(h, at, 12), whole)
    assert L._minima(h[:0], np.array([0]), 12).shape == (0, 12)
