"""Commits of several tables, and the inverted index that is stored by them."""

import re

import pytest
from pyspark.sql import functions as F

from quarry import schema
from quarry.operators import search
from quarry.plans import terms
from quarry.sources import store as stores
from quarry.sources.store import Commit, Store

A, B = "urn:a", "urn:b"


def provisions(spark, norm, *ids):
    known = {"id": F.concat(F.lit(f"{norm}!"), "i"), "norm_urn": F.lit(norm), "type": F.lit("artigo"), "text": F.concat(F.lit("text "), "i"), "path": F.col("i")}
    return spark.createDataFrame([(i,) for i in ids], "i string").select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.PROVISION])


def link(spark, *pairs):
    return spark.createDataFrame([(o, t, None, "see", False) for o, t in pairs], schema.XREF)


def state(store):
    return {n: sorted(map(str, store.read(n).collect())) for n in ("provision", "xref", "ingest_log")}


def ingest(spark, store, day):
    """A batch as the stream commits it."""
    norms = spark.createDataFrame([(A,)], "norm_urn string")
    with store.commit() as changes:
        changes.put_provisions(provisions(spark, A, "1", f"new{day}"), norms)
        changes.put_links(link(spark, (f"{A}!1", f"{B}!1")))
        changes.resolve_pending()
        changes.log(spark.sql(f"SELECT '{A}' AS norm_urn, 'sha{day}' AS source_sha256, TIMESTAMP '2024-01-0{day} 00:00:00' AS at"))


def test_a_failure_between_any_two_steps_leaves_the_former_state(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    store.put_provisions(provisions(spark, B, "1"))
    ingest(spark, store, 1)
    before, write, put, steps = state(store), Commit._written, stores.Files.put_new, 0
    assert before["xref"] and "resolved=True" in before["xref"][0]
    for failing in range(50):
        done = []

        def step(original, *args, failing=failing, done=done):
            if len(done) == failing:
                raise OSError("lost")
            done.append(1)
            return original(*args)

        monkeypatch.setattr(Commit, "_written", lambda *args: step(write, *args))
        monkeypatch.setattr(stores.Files, "put_new", lambda *args: step(put, *args))
        try:
            ingest(spark, store, 2)
            steps = failing
            break
        except OSError:
            assert state(Store(spark, store.root)) == before
    after = state(store)
    assert steps > 6 and any("new2" in x for x in after["provision"]) and any("sha2" in x for x in after["ingest_log"])
    assert store.vacuum() and state(store) == after and store.vacuum() == []


def test_commits_of_two_writers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.put_provisions(provisions(spark, A, "1"))
    with pytest.raises(schema.Conflict), store.commit() as changes:
        changes.replace("provision", provisions(spark, B, "1"))
        store.put_provisions(provisions(spark, A, "2"))
    assert [r.id for r in store.read("provision").collect()] == [f"{A}!2"]


def test_norms_are_replaced_alone(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.put_provisions(provisions(spark, A, "1", "2").unionByName(provisions(spark, B, "1")))
    store.put_links(link(spark, (f"{A}!1", f"{B}!1"), (f"{A}!2", f"{A}!1"), (f"{B}!1", f"{A}!2")))
    assert store.resolve_pending() == 3 and store.count("xref", A) == 2
    segments = dict(store.state["segments"]["provision"])
    store.put_provisions(provisions(spark, B, "9"))
    assert {(r.origin_id, r.resolved) for r in store.read("xref").collect()} == {(f"{A}!1", False), (f"{A}!2", True)}
    assert set(segments) < set(store.state["segments"]["provision"]) and store.count("provision") == 3
    store.put_provisions(provisions(spark, A).limit(0), spark.createDataFrame([(A,)], "norm_urn string"))
    assert [r.id for r in store.read("provision").collect()] == [f"{B}!9"] and store.count("xref") == 0
    store.compact("provision")
    assert len(store.state["segments"]["provision"]) == 1 and store.count("provision", B) == 1
    with pytest.raises(schema.QuarryError):
        store.read("nothing")


def test_a_null_norm_is_a_norm(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "n int, norm_urn string")
    store.replace("t", rows)
    store.replace("t", rows.where("n = 3"))
    assert sorted(r.n for r in store.read("t").collect()) == [2, 3]


DOCS = [(1, A, "contrato de trabalho"), (2, A, "contratos e cláusulas abusivas"), (3, B, "cláusula abusiva do contrato"), (4, B, None), (5, None, "trabalhos")]


def test_index_reads_the_buckets_of_asked_terms(spark, tmp_path):
    store, docs = Store(spark, f"file://{tmp_path}/s"), spark.createDataFrame(DOCS, "id long, norm_urn string, text string")
    terms.build(store, docs)
    assert terms.documents(store) == 5
    asked = spark.createDataFrame([(7, "Cláusulas"), (8, "trabalho"), (9, "nada")], "query_id long, text string")
    found = terms.bm25(store, asked)
    assert {(r.query_id, r.id) for r in found.collect()} == {(7, 2), (7, 3), (8, 1), (8, 5)}
    posts = terms.postings(store, spark.createDataFrame([("contrat",)], "term string"))
    plan = posts._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[.*bucket", plan)
    assert posts.select(F.input_file_name().alias("f")).distinct().count() == 1
    terms.build(store, docs.where("id = 3").withColumn("text", F.lit("nada")), spark.createDataFrame([(B,)], "norm_urn string"))
    assert terms.documents(store) == 4
    assert {(r.query_id, r.id) for r in terms.bm25(store, asked).collect()} == {(7, 2), (8, 1), (8, 5), (9, 3)}
    with pytest.raises(schema.IncompatibleIndex):
        terms.build(store, docs, analysis=search.LETTERS)
    assert terms.bm25(Store(spark, f"file://{tmp_path}/none"), asked).collect() == []


def test_stored_and_direct_postings_give_the_same(spark, tmp_path):
    store, docs = Store(spark, f"file://{tmp_path}/s"), spark.createDataFrame(DOCS, "id long, norm_urn string, text string")
    terms.build(store, docs)
    asked = spark.createDataFrame([(7, "Cláusulas do contrato"), (8, "trabalho")], "query_id long, text string")
    direct = search.bm25(asked, search.postings(docs, "text", "id", search.PORTUGUESE), 5, analysis=search.PORTUGUESE)
    assert sorted(map(tuple, terms.bm25(store, asked).collect())) == sorted(map(tuple, direct.collect()))
