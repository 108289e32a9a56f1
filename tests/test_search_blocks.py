"""Searches in blocks against brute force, and how texts' words meet the terms that are asked for."""

import random

import numpy as np
import pytest
from quarry.operators import search

rnd = random.Random(11)
WORDS = [f"{a}{b}{c}" for a in "abcdé" for b in "xyz" for c in "uvw"]


@pytest.fixture
def texts(spark):
    rows = [(i, " ".join(rnd.choices(WORDS, weights=range(1, len(WORDS) + 1), k=rnd.randint(0, 40)))) for i in range(70)] + [(70, None), (71, ""), (72, "axu " * 500)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def rows_of(packed):
    terms = {r.no: r.term for r in packed.terms.collect()}
    return sorted((r.id, r.length, sorted((terms[n], tf) for n, tf in zip(r.nos, r.tfs, strict=True))) for r in packed.rows.collect())


def test_words_of_texts_are_looked_up_without_a_row_for_each(spark, texts, monkeypatch):
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(WORDS[::2])], "query_id long, term string")
    want = rows_of(search.packed_postings(search.postings(texts, terms=asked), asked))
    monkeypatch.setattr(search, "SENT_ROWS", 3)
    monkeypatch.setattr(search, "WORDS", 50)
    with monkeypatch.context() as m:
        m.setattr(search, "sent", lambda df: pytest.fail("words are joined"))
        assert rows_of(search.packed(texts, asked)) == want
        assert rows_of(search.packed(texts, asked.limit(0))) == []
    monkeypatch.setattr(search, "SENT_TERMS", 3)
    assert rows_of(search.packed(texts, asked)) == want


@pytest.mark.parametrize(("dense", "hits", "documents"), [(128, 1 << 18, 4096), (1, 7, 16), (10**9, 50, 8)])
def test_bm25_in_blocks_against_all_pairs(spark, texts, monkeypatch, dense, hits, documents):
    for name, value in (("DENSE", dense), ("HITS", hits), ("DOCUMENTS", documents), ("QUERIES", 5), ("CELL", 300), ("ASKED", 200)):
        monkeypatch.setattr(search, name, value)
    asks = texts.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "query_id")
    got = search.bm25(asks, search.packed(texts, search.asked_terms(asks)), 73, k=6).collect()
    held = {r.doc_id: (r.text or "").split() for r in texts.collect()}
    df = {w: sum(w in ws for ws in held.values()) for w in WORDS}
    want = []
    for q in held:
        if q % 3 == 0:
            scores = []
            for d, ws in held.items():
                w = sum(np.log((73 - df[t] + 0.5) / (df[t] + 0.5) + 1) * ws.count(t) * 2.2 / (ws.count(t) + 1.2 * (0.25 + 0.75 * len(ws) / 256)) for t in {*held[q]} & {*ws})
                if {*held[q]} & {*ws}:
                    scores.append((-round(w, 6), d))
            want += [(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(scores)[:6])]
    assert sorted((r.query_id, r.rank, r.id) for r in got) == sorted((q, i, d) for q, d, _, i in want)
    scores = {(q, d): s for q, d, s, _ in want}
    assert all(r.score == pytest.approx(scores[r.query_id, r.id], abs=2e-6) for r in got)


@pytest.mark.parametrize("same_id", [True, False])
def test_cosine_in_blocks_against_all_pairs(spark, monkeypatch, same_id):
    for name, value in (("BLOCK", 7), ("VECTORS", 20), ("QUERIES", 4)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist(), i % 2) for i in range(90)]  # many equal scores, some vectors of zeros
    vectors = spark.createDataFrame(rows, "id long, vector array<double>, group int")
    got = search.cosine(vectors.where("id % 5 = 0").withColumnRenamed("id", "query_id"), vectors, k=8, same_id=same_id).collect()
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-300) for i, v, _ in rows}
    want = []
    for q in range(0, 90, 5):
        near = sorted((-round(float(unit[q] @ unit[i]), 6) + 0.0, i) for i in range(90) if i % 2 == q % 2 and (same_id or i != q))
        want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(near[:8])]
    assert sorted((r.query_id, r.id, r.rank) for r in got) == sorted((q, i, n) for q, i, _, n in want)


def test_folded_postings_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(search, "FOLDED", 30)
    monkeypatch.setattr(search, "KNOWN", 5)
    texts = ["contratos e contrato de trabalho", "Trabalhos abusivos; abusiva ABUSIVO", None, "", "de e o", "cláusula " * 70]
    docs = spark.createDataFrame([(i, f"n{i % 2}", texts[i % 6]) for i in range(24)], "doc_id long, norm_urn string, text string").repartition(3).cache()
    want = {0: {("contrat", 2, 3), ("trabalh", 1, 3)}, 1: {("trabalh", 1, 4), ("abus", 3, 4)}, 5: {("cláusul", 70, 70)}}
    found = search.postings(docs, analysis=search.PORTUGUESE, more=("norm_urn",))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    rows = [(r.id, r.norm_urn, r.term, r.tf, r.length) for r in found.collect()]
    assert sorted(rows) == sorted((i, f"n{i % 2}", *t) for i in range(24) for t in want.get(i % 6, ()))
    some = search.postings(docs, analysis=search.PORTUGUESE, terms=spark.createDataFrame([("contrat",)], "term string"))
    assert sorted((r.id, r.tf) for r in some.collect()) == [(i, 2) for i in range(0, 24, 6)]
    twice = search.postings(docs.where("doc_id = 0").union(docs.where("doc_id = 0")), analysis=search.PORTUGUESE)
    assert sorted((r.id, r.term, r.tf) for r in twice.collect()) == [(0, "contrat", 4), (0, "trabalh", 2)]
