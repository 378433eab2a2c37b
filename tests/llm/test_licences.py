import random
import re

import pytest

from portflow.llm import licences as L


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("seed", range(4))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(4)]
    auto = L.Automaton(seqs)
    subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = [rng.randrange(4) for _ in range(200)]
    for i, (s, n) in enumerate(auto.stream(text), 1):
        assert n == max((k for k in range(1, 13) if k <= i and tuple(text[i - k : i]) in subs), default=0)
        if n:
            m = tuple(text[i - n : i])
            assert auto.places[s] == {(k, e) for k, q in enumerate(seqs) for e in range(n, len(q) + 1) if tuple(q[e - n : e]) == m}


def corpus():
    rng = random.Random(8)
    pieces = [*L.BASE, "Under the MIT-License", "CC BY-NC 4.0", "cc by", "under the", "Apache License, Version 2.0", "ünder the mit license", "\n\n", "filler", "é2", "the mit", "cc by nc by nc", "under the mit license under the mit license"] + [t for _, t in L.NOTICES[:12]]
    rows = [(i, rng.choice([" ", ", ", "\n", "--"]).join(rng.choice(pieces) for _ in range(rng.randrange(14)))) for i in range(300)]
    rows += [(400, None), (401, ""), (None, "Released under the MIT License."), (402, "Licensed under the GNU General Public License, version 3."), (403, "word " * 50_000 + "CC-BY-NC"), (5, rows[5][1])]
    notice = L.NOTICES[0][1].split()
    rows += [(500, " ".join(notice[:20] + ["x"] + notice[21:])), (501, " ".join(notice[:12])), (502, " ".join(notice[30:] + notice[:30]))]
    return rows


def test_base_phrases_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "l", 0.5) for i, t in rows], "doc_id long, text string, labels string, score double").repartition(4)
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.scan(df).collect())
    want = []
    for i, t in rows:
        w = words(t)
        places = [(a, label) for p, label in L.BASE.items() for a in range(len(w)) if w[a : a + len(p.split())] == p.split()]
        starts = [a for a, _ in places]
        want.append((str(i), len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    assert got == sorted(want, key=str) or sorted(got, key=str) == sorted(want, key=str)
    out = L.scan(df).collect()
    assert len(out) == len(rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r for r in out}
    assert by[402].labels == "gpl-3" and by[500].labels == "mit" and by[500].n_base == 0 and by[501].labels == "" and 0 < by[501].score < 0.5
    assert by[502].labels == ""  # out of order: no chain covers the notice
    assert L.scan(df.limit(0)).count() == 0


def test_notices_of_one_family_are_told_apart(spark):
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    lgpl = gpl.replace("program", "library").replace("General", "Lesser General").replace("version 2", "version 2.1")
    cc = "Licensed under a Creative Commons Attribution 4.0 International License"
    rows = [
        ("gpl-2", gpl), ("gpl-3", gpl.replace("version 2", "version 3")), ("", gpl.replace("version 2", "version 1")),
        ("lgpl", lgpl), ("lgpl", lgpl.replace("2.1", "3")), ("cc-by", cc), ("cc-by-sa", cc.replace("Attribution", "Attribution-ShareAlike")),
        ("gpl-2,lgpl", "a b c " + gpl + " x " * 60 + lgpl),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.scan(df).collect()}
    assert [got[i].labels for i in range(len(rows))] == [x for x, _ in rows]
    n, m = len(words(gpl)), len(words(lgpl))
    assert [(s.label, s.first_word, s.end_word, s.coverage) for s in got[7].spans] == [("gpl-2", 3, 3 + n, 1.0), ("lgpl", 63 + n, 63 + n + m, 1.0)]
    twice = L.Scanner().scan(__import__("pyarrow").array([gpl + " x " * 60 + gpl]))
    assert [s["first_word"] for s in next(twice)[-1]] == [0, n + 60]
