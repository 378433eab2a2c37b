import math
import random
import re
import zlib

from portflow.llm import toxicity as T


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def test_grammar_scores_clauses():
    m = T.Model({"idiot": 2.0}, {"vequ": 3.0}, [-3.0, 1.0, 1.0, 1.0])
    f = T.Features(m)
    g = lambda t: f(t)[1]  # noqa: E731  the largest clause
    assert g("What an idiot.") == 2.0
    assert g("You idiot.") > g("an idiot.") > g("you are not an idiot.") > 0
    assert g("He said: x") == 0.0
    assert g("she said an idiot came") < g("an idiot came")
    assert g("i will kill") == 0.0 and g("kill time. you now") == 0.0 and g("you go. i kill") == 0.0
    assert g("kill you now") == g("i will kill you") == g("i tell you i kill") == 2.0  # the target may stand on either side
    assert g("ich werde dich töten") == g("je vais te frapper toi") == g("voy a matar a ellos") == 2.0
    assert g("idiot, you") == 2.0 and g("an idiot you are") == g("you are an idiot") == 2.6
    assert g("not now. an idiot") == 2.0  # a clause end resets the negation
    assert g("le vequance") == 3.0
    assert f("") == f(None) == f("\n!!") == (0.0, 0.0, 0.0)
    assert len(f("idiot. idiot, idiot")) == 3


def test_composition_equals_separate_transducers():
    rng = random.Random(5)
    parts = (T.INSULTS, T.AIMED, T.THREATENED, T.NEGATED, T.REPORTED)
    whole = T.Composition(*parts)
    for _ in range(300):
        symbols = [rng.randrange(7) for _ in range(rng.randrange(20))]
        weights = [rng.random() if x in (T.INSULT, T.THREAT) else 0.0 for x in symbols]
        states, total, hit, want = [0] * len(parts), 0.0, False, []
        for x, w in zip(symbols + [T.END], weights + [0.0]):
            factor = 1.0
            for k, p in enumerate(parts):
                states[k], f = p.step(states[k], x)
                factor *= f
            if x in (T.INSULT, T.THREAT):
                total, hit = total + w * factor, True
            elif x == T.END and hit:
                want.append(total)
                total, hit = 0.0, False
        got = whole.clauses(symbols, weights)
        assert len(got) == len(want) and all(abs(a - b) < 1e-12 for a, b in zip(got, want))


def clause_scores(text, insults):
    """A clause's score by its words, with no states: each hit's weight times what the words around it say."""
    out = []
    for clause in re.split(r"[.,;:!?\n]", text.lower()):
        words = re.findall(r"[^\W_]+", clause)
        total, hit = 0.0, False
        for i, w in enumerate(words):
            if w not in insults and w not in T.THREATS:
                continue
            hit = True
            weight = insults.get(w, 2.0)
            aimed = any(x in T.TARGETS and x not in insults for x in words)
            if w in insults:
                weight *= 1.3 if aimed else 1.0
            elif not aimed:
                weight = 0.0
            weight *= 0.4 if any(x in T.NEGATIONS for x in words[max(0, i - 3) : i]) else 1.0
            weight *= 0.6 if any(x in T.REPORTS for x in words[:i]) else 1.0
            total += weight
        if hit:
            out.append(total)
    return out


def test_clauses_against_brute_force():
    rng = random.Random(8)
    insults = {"idiot": 2.0, "grumf": 1.5}
    f = T.Features(T.Model(insults, {}, [0.0, 1.0, 1.0, 1.0]))
    words = ["idiot", "grumf", "kill", "töten", "you", "dich", "ellos", "not", "kein", "said", "écrit", "ana", "bolo", "cedi", "dufo"]
    for _ in range(2000):
        text = "".join(rng.choice(words) + rng.choice([" "] * 6 + [". ", ", ", "\n"]) for _ in range(rng.randrange(14)))
        want = [x for x in clause_scores(text, insults) if x > 0]
        got = f(text)
        assert abs(got[0] - math.log1p(sum(want))) < 1e-9 and abs(got[1] - max(want, default=0.0)) < 1e-9 and abs(got[2] - math.log1p(len(want))) < 1e-9, text


def test_learns_and_scores_every_row(spark):
    rng = random.Random(1)
    plain = ["ana", "bolo", "cedi", "dufo", "elga"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(30)]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(30)] = rng.choice(["grumf", "snark", "zarfo" + rng.choice("abcdefgh")])
        rows.append((i, " ".join(words), "x", 1.0))
        if i % 3 == 0:
            labels.append((i, 1, int(bad)))
    rows += [(None, "a grumf snark zarfoa", "x", 2.0), (5000, None, None, None), (5001, "", "x", None), (5, rows[5][1], "x", 1.0), (5002, "ana " * 40_000 + "grumf snark", "x", 0.0)]
    labels += [(0, 0, 0), (None, 1, 1), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, toxicity double").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.train(docs, lab)
    assert {"grumf", "snark"} <= set(model.words) and any(b.startswith("zarf") for b in model.beginnings)
    got = T.score(docs, model).select("doc_id", "text", "toxicity").collect()
    assert len(got) == len(rows)
    wrong = [r.doc_id for r in got if r.doc_id is not None and r.doc_id < 900 and (r.toxicity >= 0.5) != (r.doc_id % 6 == 0)]
    assert len(wrong) <= 5
    assert all(0 <= r.toxicity <= 1 for r in got)
    empty = T.train(docs, lab.limit(0))
    assert not empty.words and len({r.toxicity for r in T.score(docs.where("text is not null and text not like '%kill%'"), empty).collect()}) == 1
    assert T.score(docs.limit(0), model).count() == 0


def test_held_out_rows_are_never_learned(spark):
    rows = [(i, "alpha beta" + (" horrid" if fold(i) == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(fold(i) == 0 or i % 2)) for i in range(300)], "doc_id long, toxic int")
    assert "horrid" not in T.train(docs, lab).words
