"""The pipeline against brute force, stage by stage, on a fixture with every kind of bad document planted."""

import random

import corpus_pipeline
import pytest

from portflow.llm.tokens import default_vocabulary, encoder

from .test_line_dedup import brute as brute_lines
from .test_near_dedup import brute as brute_near


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in "klmnpr" for b in "aeiou" for c in ("sto", "vin", "dra", "quel")]
    draw = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    line, passage = draw(9), draw(25)
    for i in range(500):
        lines = [draw(rng.randrange(8, 40)) for _ in range(rng.randrange(1, 4))]
        if i % 7 == 0:
            lines[0] += " grumf snark" if i % 2 else " snark zwort"
        if i % 9 == 1:
            lines.append(line)
        if i % 50 == 3:
            lines.append(draw(4) + " " + passage + " " + draw(4))
        rows.append((i, "\n".join(lines)))
        if i % 2 == 0 or i % 7 == 0:
            labels.append((i, 1, int(i % 7 == 0)))
    rows += [(600 + j, rows[2][1]) for j in range(5)]
    base = rows[4][1].split(" ")
    rows += [(700 + j, " ".join(base[:1] + [draw(1)] + base[2:])) for j in range(4)]
    rows += [(800, None), (801, ""), (802, " \n "), (None, draw(30))]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(i, t, "en", f"s{i}" if i else None, len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, toxicity string").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, passage


def test_stages_against_brute_force(spark, folder):
    d, rows, passage = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, d), "test")
        if name != "packing":
            assert out.columns == docs.columns
            kept[name] = [(r.doc_id, r.text) for r in out.collect()]
        docs, last = out, out
    bad = lambda t: any(w in (t or "") for w in ("grumf", "snark", "zwort"))
    by = lambda rs: sorted(rs, key=lambda r: (r[0] is None, r[0] or 0))
    assert by(kept["toxicity"]) == by([r for r in rows if not bad(r[1])])

    gone = {(m[1] if not m[0] else None, m[2]) for m, k in brute_lines(kept["toxicity"]) if m != k}
    want = []
    for i, t in kept["toxicity"]:
        left = [x for n, x in enumerate((t or "").split("\n")) if (i, n) not in gone]
        if not any(j == i for j, _ in gone):
            want.append((i, t))
        elif any(x.strip() for x in left):
            want.append((i, "\n".join(left)))
    assert by(kept["line_dedup"]) == by(want)

    least = {(None if none else i): c for none, i, _, c in brute_near(kept["line_dedup"], k=5)}
    assert by(kept["near_dedup"]) == by([r for r in kept["line_dedup"] if least[r[0]] in (r[0], None)])
    assert by(kept["decontamination"]) == by([r for r in kept["near_dedup"] if passage not in (r[1] or "")])

    enc = encoder(default_vocabulary()).encode
    total = sum(len(enc(t)) // 4 + 1 for _, t in kept["decontamination"])
    pieces = last.collect()
    assert sum(r.length for r in pieces) == total
    assert {r.doc_id for r in pieces} == {i for i, _ in kept["decontamination"]}
    again = corpus_pipeline.run(spark, d)
    assert again.columns == last.columns and again.agg({"length": "sum"}).first()[0] == total


def test_empty_tables(spark, folder, tmp_path):
    d = folder[0]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
