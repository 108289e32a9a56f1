"""Raw documents as a data source, and the stages from fetching to the index."""

import json

import pytest
from pyspark.sql import functions as F

from quarry import schema
from quarry.operators import search
from quarry.plans import stages
from quarry.sources import documents, raw
from quarry.sources.store import Store

CF, CDC, CC = (row[0] for row in schema.CATALOGUE)


@pytest.fixture
def folder(spark, tmp_path):
    where = f"{tmp_path}/raw"
    for urn, page in ((CF, "<p>Art. 1º Da lei, na forma do art. 2º.</p><p>Art. 2º Dois.</p>"), (CDC, "<p>Art. 1º Do consumo.</p>"), (CC, "<p>Art. 1º Do código.</p>")):
        raw.save(spark, f"file://{where}", urn, f"http://{urn[-4:]}", "text/html; charset=utf-8", page.encode())
    return where


def test_documents_are_read_by_their_records(spark, folder, tmp_path):
    got = documents.read(spark, folder)
    assert [r.urn for r in got.orderBy("urn").collect()] == sorted([CF, CDC, CC]) and got.columns[:4] == ["path", "urn", "url", "content"]
    old = raw.load(spark, f"file://{folder}").select("urn", "url", "content", "sha256")
    assert got.select(*old.columns).exceptAll(old).count() == 0
    (tmp_path / "raw" / "lost.htm").write_bytes(b"x")
    assert documents.read(spark, folder).count() == 3
    with pytest.raises(Exception, match="lost.htm: no record"):
        documents.read(spark, folder, strict=True).count()
    (tmp_path / "empty").mkdir()
    assert documents.read(spark, f"{tmp_path}/empty").count() == 0


def test_a_filter_on_ids_chooses_the_files(spark, folder, tmp_path):
    for wrong in (CDC, CC):  # what is not asked for is not read
        (tmp_path / "raw" / (raw.file_name(wrong) + ".htm")).write_bytes(b"changed")
    got = documents.read(spark, folder)
    assert [r.urn for r in got.where(F.col("urn") == CF).collect()] == [CF]
    assert [r.urn for r in got.where(F.col("urn").isin(CF, "other") & F.col("content_type").contains("html")).collect()] == [CF]
    assert got.where(F.col("urn") == "other").count() == 0
    with pytest.raises(Exception, match="differs from its record"):
        got.where(F.col("urn") == CDC).collect()
    twin = CF.replace(";", ":")  # the same file name, another id
    assert raw.file_name(twin) == raw.file_name(CF) and got.where(F.col("urn") == twin).count() == 0


def test_groups_follow_bytes_and_lose_nothing(spark, folder):
    documents.read(spark, folder)
    few = spark.read.format("raw_documents").option("groupBytes", "1").load(folder)
    assert few.rdd.getNumPartitions() == 3 and few.count() == 3
    reader = documents.RawReader({"path": folder, "groupBytes": "70"})
    assert sorted(p for g in reader.partitions() for p in g.paths) == sorted(r.path for r in few.collect())


def test_stages_in_turn(spark, tmp_path):
    store, where, encode = Store(spark, f"file://{tmp_path}/s"), f"file://{tmp_path}/raw", search.hashed_encoder(8)
    pages = {row[3]: f"<p>Art. 1º Texto {n}, na forma do art. 2º.</p><p>Art. 2º Outro.</p>" for n, row in enumerate(schema.CATALOGUE)}
    ingested, indexed = stages.run(spark, where, store, lambda url: ("text/html", pages[url].encode()), encode, "m", 8, limit=2)
    assert {(r.norm_urn, r.provisions, r.links) for r in ingested.collect()} == {(CF, 2, 1), (CDC, 2, 1)}
    assert stages.total(indexed).first().asDict() == {"norms": 2, "chunks": 4, "removed": 0}
    norm = store.read("norm").where(F.col("urn") == CDC).first()
    assert (norm.type, norm.number, norm.year, norm.alias, norm.published.isoformat()) == ("lei", "8078", 1990, "CDC", "1990-09-11")
    assert all(r.resolved for r in store.read("xref").collect())
    assert {r.source_sha256 for r in store.norms_indexed().collect()} == {r.sha256 for r in documents.read(spark, where).collect()}
    raw.save(spark, where, CF, "http://x", "text/html", "<p>Art. 1º Só um.</p>".encode())
    assert [tuple(r) for r in stages.ingest(spark, where, store, [CF]).collect()] == [(CF, 1, 0)]
    assert store.count("provision", CDC) == 2
    assert stages.total(ingested.limit(0)).first().norms == 0


def test_a_document_without_parser_leaves_the_store(spark, folder):
    store = Store(spark, f"file://{folder}-store")
    stages.ingest(spark, folder, store)
    raw.save(spark, f"file://{folder}", CF, "http://x", "application/pdf", b"%PDF", suffix="pdf")
    with pytest.raises(Exception, match="no parser takes"):
        stages.ingest(spark, folder, store)
    assert store.count("provision", CF) == 2


def test_status_tells_what_is_there(spark, folder, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = {(r.part, r.name): r.rows for r in stages.status(spark, f"file://{folder}", store).collect()}
    assert rows[("raw", "with record")] == 3 and rows[("index", None)] is None and rows[("store", "provision")] == 0
    (tmp_path / "raw" / "lost.htm").write_bytes(b"x")
    stages.ingest(spark, folder, store)
    store.open_index("m", 8)
    rows = {(r.part, r.name): r.rows for r in stages.status(spark, f"file://{folder}", store).collect()}
    assert rows[("raw", "no record")] == 1 and rows[("store", "provision")] == 4
    assert rows[("index", json.dumps({"model": "m", "dimension": 8}))] == 0
