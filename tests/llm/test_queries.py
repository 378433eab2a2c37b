"""Every registered query of the subpackage on a whole given folder, against SQL or a brute-force version."""

import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from portflow.llm import toxicity as T
from portflow.llm.tokens import default_vocabulary, encoder

from . import test_decontaminate, test_licences, test_line_dedup, test_near_dedup, test_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "pages", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("select doc_id, text from documents").fetchall()


def run(spark, key):
    return E.queries()[key](spark, SF)


def test_all_are_registered():
    names = [k for k in E.queries() if k.startswith("op")]
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 14)] == [1] * 13 and "pipeline" in E.queries()


@pytest.mark.parametrize("key", ["op2_neighbours", "op3_near_duplicates", "op11_inner_products", "op12_conversations", "op13_source_divergence"])
def test_against_sql(spark, con, key):
    df = run(spark, key)
    names = sorted(df.columns)
    got = sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in names) for r in df.collect())
    res = con.execute(E.oracle_sql()[key])
    at = {d[0]: i for i, d in enumerate(res.description)}
    assert sorted(at) == names
    assert got == sorted(tuple(round(r[at[c]], 9) if isinstance(r[at[c]], float) else r[at[c]] for c in names) for r in res.fetchall())


def test_op3_against_brute_force(spark, docs):
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in run(spark, "op3_near_duplicates").collect()), key=str)
    assert got == test_near_dedup.brute(docs)


def test_op4_scores_all_and_holds_out(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op4_toxicity").collect()}
    assert set(got) == {i for i, _ in docs}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())


def test_op4_held_out_accuracy(spark):
    """On the larger given folder: labels of the held-out fold."""
    sf = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = T.score(docs.select("doc_id", "text"), T.train(docs, labels)).join(labels, "doc_id").where(T.fold("doc_id") == 0).select("toxic", "toxicity").collect()
    bad, good = ([r.toxicity for r in rows if r.toxic == t] for t in (1, 0))
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.93 and np.mean(np.array(bad) >= 0.5) > 0.8 and np.mean(np.array(good) >= 0.5) < 0.01


def test_op5_against_the_library(spark, docs):
    tok = encoder(default_vocabulary()).tok
    at, want = 0, []
    for i, t in sorted(docs):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, run(spark, "op5_token_ids").collect())) == want


def test_op6_against_brute_force(spark, docs):
    from portflow.llm.licences import BASE

    want = {}
    for i, t in docs:
        w = test_licences.words(t)
        places = [(a, label) for p, label in BASE.items() for a in range(len(w)) if w[a : a + len(p.split())] == p.split()]
        want[i] = (len(w), len(places), min((a for a, _ in places), default=None), max((a for a, _ in places), default=None), ",".join(sorted({x for _, x in places})))
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in run(spark, "op6_licences").collect()}
    assert got == want


def test_op7_against_brute_force(spark, docs):
    got = {((r.doc_id is None, r.doc_id or 0, r.line_no), (r.keep_doc_id is None, r.keep_doc_id or 0, r.keep_line_no)) for r in run(spark, "op7_fuzzy_lines").collect()}
    want = set(test_line_dedup.brute(docs))
    assert len(got ^ want) <= 0.01 * len(want)  # the stated miss probability of banding


def test_op8_against_brute_force(spark, docs):
    got = sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in run(spark, "op8_repeats").collect()), key=str)
    assert got == test_repeats.brute(docs, 400)


def test_op9_against_brute_force(spark, con, docs):
    items = [(i, t.lower().split()) for i, t in con.execute("select item_id, text from benchmark").fetchall()]
    want = set()
    for i, t in docs:
        words = (t or "").lower().split()
        seen = set(words)
        for j, x in items:
            e = int(0.2 * len(x))
            if sum(w not in seen for w in x) <= e and test_decontaminate.distance(x, words) <= e:
                want.add((i, j))
    assert {(r.doc_id, r.item_id) for r in run(spark, "op9_contaminated").collect()} == want


def test_op10_packs_everything(spark, docs):
    from .test_packing import check

    check(run(spark, "op10_packing"), docs, 1024)
