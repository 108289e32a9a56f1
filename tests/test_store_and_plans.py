import datetime
import json

import pytest
from pyspark.sql import functions as F
from quarry import schema
from quarry.operators import search
from quarry.plans import answer, index, parse
from quarry.sources import gold, html, raw
from quarry.sources.store import Store
from quarry.streaming.ingest import ingest_stream

D = datetime.date
CF, CDC = schema.CATALOGUE[0][0], schema.CATALOGUE[1][0]
PAGE = """<html><body><table><tr><td><p>TÍTULO II <br> Dos Direitos</p></td></tr></table>
<p><strike>Art. 6<sup>o</sup> São direitos sociais a educação, a saúde. <a name="art6."></a></strike></p>
<p><strike>Art. 6º São direitos sociais a educação, a moradia. (Redação dada pela Emenda nº 26, de 2000)</strike></p>
<p><a name="art6"></a>Art. 6º São direitos sociais a educação, o transporte, na forma do art. 7º, § 1º. (Redação dada pela Emenda nº 90, de 2015)</p>
<p>Parágrafo único. Todo brasileiro terá renda. (Incluído pela Emenda nº 114, de 2021)</p>
<p>continuação do parágrafo.</p><p>Art. 7º Texto com <strike>parte velha</strike> parte nova. (Vide Lei nº 1)</p><p>I - primeiro;</p><p>a) alínea;</p>
<p>Art. 3º citado em prosa</p><p>§ 1º Outro.</p><p>ATO DAS DISPOSIÇÕES CONSTITUCIONAIS TRANSITÓRIAS</p><p>Art. 1º Do ato.</p>
<p>TÍTULO IX Sem artigos</p></body></html>"""


def documents(spark, page=PAGE, urn=CF):
    return spark.createDataFrame([(urn, D(1988, 10, 5), page)], "norm_urn string, published date, html string")


def test_leaf_blocks():
    got = html.leaf_blocks(PAGE)
    assert got[0]["text"] == "TÍTULO II Dos Direitos" and [b["pos"] for b in got] == list(range(len(got)))
    assert got[1]["struck"] and got[1]["anchors"] == ["art6."]
    assert (got[2]["struck"], got[2]["year"], got[2]["action"]) == (True, 2000, "redação dada")
    assert got[6]["text"] == "Art. 7º Texto com parte nova. (Vide Lei nº 1)" and got[6]["note"] is None
    assert html.leaf_blocks("") == [] and html.leaf_blocks("<p>a<p>b") and len(html.leaf_blocks("<ul><li>a<li>b</ul>")) == 2
    assert html.decode("São".encode("cp1252")) == html.decode("São".encode()) == "São"


def test_documents_become_provisions(spark):
    rows = {r.path: r for r in parse.provisions(documents(spark)).collect()}
    assert set(rows) == {"tit2", "tit2/art6@1", "tit2/art6@2", "tit2/art6", "tit2/art6/parunico", "tit2/art7", "tit2/art7/inc1", "tit2/art7/inc1/ali1", "tit2/art7/par1", "adct/art1"}
    one, two, now = rows["tit2/art6@1"], rows["tit2/art6@2"], rows["tit2/art6"]
    assert (one.valid_from, one.revoked_on) == (D(1988, 10, 5), D(2000, 1, 1))
    assert (two.valid_from, two.revoked_on) == (D(2000, 1, 1), D(2015, 1, 1))
    assert (now.valid_from, now.revoked_on) == (D(2015, 1, 1), None) and "transporte" in now.text and "transporte" not in two.text
    assert rows["tit2/art6/parunico"].text.endswith("renda. continuação do parágrafo.") and rows["tit2/art6/parunico"].valid_from == D(2021, 1, 1)
    assert rows["tit2/art7/inc1/ali1"].text == "alínea; Art. 3º citado em prosa"
    assert rows["tit2/art7/par1"].parent_id == f"{CF}!art7" and rows["adct/art1"].id == f"{CF}!adct_art1"
    assert (rows["tit2/art7"].ordinal, one.ordinal, two.ordinal, now.ordinal) == (4, 1, 2, 3)


def test_links(spark):
    got = parse.links(parse.provisions(documents(spark))).collect()
    assert {(r.origin_id, r.target_urn) for r in got} >= {(f"{CF}!art6", f"{CF}!art7_par1")}


def test_store_replaces_norms_and_keeps_links_right(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.put_provisions(parse.provisions(documents(spark)))
    store.put_provisions(parse.provisions(documents(spark, "<p>Art. 1º Do consumo.</p>", CDC)))
    pending = parse.links(store.read("provision")).withColumns({"target_id": F.lit(None).cast("string"), "resolved": F.lit(False)}).select(*schema.XREF.fieldNames())
    n = store.put_links(pending)
    assert n == store.put_links(pending) and store.read("xref").count() == n  # a second time changes nothing
    assert store.resolve_pending() > 0 and store.resolve_pending() == 0
    store.put_provisions(parse.provisions(documents(spark, "<p>Art. 1º Do consumo, de novo.</p>", CDC)))
    assert store.read("provision").where(F.col("norm_urn") == CDC).first().text == "Do consumo, de novo."
    assert store.read("provision").where(F.col("norm_urn") == CF).count() == 10 and store.read("xref").where("resolved").count() > 0
    assert store.drop("provision", CDC) == 1 and store.read("provision").where(F.col("norm_urn") == CDC).count() == 0
    norm = spark.createDataFrame([(CF, "constituicao", "1988", 1988, D(1988, 10, 5), "CF/88", None, None, None)], schema.NORM)
    store.put_norms(norm)
    store.put_norms(norm.withColumn("alias", F.lit("new")))
    assert [r.alias for r in store.read("norm").collect()] == ["new"]
    assert store.open_index("m", 8)["model"] == "m"
    with pytest.raises(schema.IncompatibleIndex):
        store.open_index("m", 16)
    assert store.open_index("m", 16, recreate=True)["dimension"] == 16
    assert {r.table: r.rows for r in store.status().collect()}["norm"] == 1


def test_index_is_replaced_norm_by_norm(spark, tmp_path):
    store, encode = Store(spark, f"file://{tmp_path}/s"), search.hashed_encoder(8)
    none = [None] * 4
    store.put_norms(spark.createDataFrame([(CF, "constituicao", "1988", 1988, D(1988, 10, 5), "CF/88", *none[:3]), (CDC, "lei", "8078", 1990, D(1990, 9, 11), *none)], schema.NORM))
    store.put_provisions(parse.provisions(documents(spark)))
    store.put_provisions(parse.provisions(documents(spark, "<p>Art. 1º um</p><p>Art. 2º dois</p>", CDC)))
    both = spark.createDataFrame([(CF,), (CDC,)], "norm_urn string")
    report = {r.norm_urn: (r.chunks, r.removed) for r in index.build(store, encode, "m", 8, both).collect()}
    assert report[CDC] == (2, 0) and report[CF][0] == store.count("chunk", CF) > 0
    store.put_provisions(parse.provisions(documents(spark, "<p>Art. 1º um, de novo</p>", CDC)))
    cdc = both.where(F.col("norm_urn") == CDC)
    assert [tuple(r) for r in index.build(store, encode, "m", 8, cdc).collect()] == [(CDC, 1, 2)]
    assert store.count("chunk", CF) == report[CF][0] and len(store.read("chunk").first().vector) == 8
    store.drop("provision", CDC)  # nothing left: nothing is found any more
    assert [tuple(r) for r in index.build(store, encode, "m", 8, cdc).collect()] == [(CDC, 0, 1)] and store.count("chunk", CDC) == 0
    with pytest.raises(schema.UnknownNorm):
        index.build(store, encode, "m", 8, spark.createDataFrame([("other",)], "norm_urn string"))
    with pytest.raises(schema.IncompatibleIndex):
        index.build(store, encode, "m", 16, both)
    assert index.build(store, encode, "m", 8).count() == 0  # none was ingested by the log


def test_raw_documents_and_orphans(spark, tmp_path):
    folder = f"file://{tmp_path}/raw"
    raw.save(spark, folder, CDC, "http://x", "text/html", "é".encode("cp1252"))
    (tmp_path / "raw" / "lost.htm").write_bytes(b"x")
    got = raw.load(spark, folder).withColumn("text", html.decoded(F.col("content"))).collect()
    assert [(r.urn, r.text) for r in got] == [(CDC, "é")]
    assert [r.path.rpartition("/")[2] for r in raw.orphans(spark, folder).collect()] == ["lost.htm"]
    name = raw.file_name(CDC) + ".htm"
    (tmp_path / "raw" / name).write_bytes(b"changed")
    (tmp_path / "raw" / f".{name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="differs from its record"):
        raw.load(spark, folder).collect()
    with pytest.raises(schema.DownloadFailed):
        raw.save(spark, folder, CF, "http://x", "text/html", b"")
    assert raw.choose_parser("text/html", "a") == "html"
    with pytest.raises(schema.ParserUnavailable):
        raw.choose_parser("application/pdf", "a.pdf")
    assert raw.catalogue(spark).count() == 3


def test_gold_lines(spark, tmp_path):
    item = {"id": "a", "pergunta": "q?", "data_referencia": "2024-01-01", "dispositivos_esperados": ["CDC art. 6º VIII"]}
    path = tmp_path / "gold.jsonl"
    path.write_text(json.dumps(item) + "\n\n" + json.dumps(item | {"id": "b", "dispositivos_esperados": [], "deve_abster": True}))
    rows = gold.load(spark, str(path)).orderBy("id").collect()
    assert rows[0].dispositivos_esperados == [f"{CDC}!art6_inc8"] and rows[1].deve_abster and rows[0].data_referencia == D(2024, 1, 1)
    path.write_text(json.dumps(item) + "\n" + json.dumps(item))
    with pytest.raises(schema.GoldError, match="line 2"):
        gold.load(spark, str(path))


def test_questions_are_answered_at_their_date(spark, tmp_path):
    def stored(df, name):  # tables, as in use: plans start from them
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    nodes = stored(parse.provisions(documents(spark)).withColumn("chunk_no", F.monotonically_increasing_id()), "nodes")
    chunks = nodes.where("text <> ''").select("chunk_no", F.col("id").alias("provision_id"), "norm_urn", "path", "type", "text", "valid_from", "revoked_on")
    encode = search.hashed_encoder(16)
    vectors = chunks.select("chunk_no", encode("text").cast("array<double>").alias("vector"))
    asked = spark.createDataFrame([(1, "direitos sociais educação transporte"), (2, "moradia educação")], "query_id long, text string").withColumn("vector", encode("text").cast("array<double>"))
    asked, vectors = stored(asked, "asked"), stored(vectors, "vectors")
    now = answer.retrieve(asked, chunks, vectors, nodes, F.lit("2020-01-01").cast("date")).collect()
    texts = {(r.query_id, r.target_path) for r in now}
    assert (1, "tit2/art6") in texts and not any("@" in p for _, p in texts)
    old = stored(answer.retrieve(asked, chunks, vectors, nodes, F.lit("2010-01-01").cast("date")), "old")
    assert "tit2/art6@2" in {r.target_path for r in old.collect()}
    first = stored(answer.answer(asked, old, answer.Extractive(), "2010-01-01"), "first")
    rows = {r.query_id: r for r in first.collect()}
    assert "moradia" in rows[2].answer and rows[2].abstention is None
    none = answer.answer(asked, old.limit(0), answer.Extractive(), "2010-01-01").first()
    assert none.answer == answer.NO_CANDIDATES and none.abstention == "no candidates"

    class Unused(answer.Extractive):
        def generate(self, *_):
            raise AssertionError("a stored request is not sent again")

    class Watched(answer.Extractive):
        def generate(self, system, docs, question):
            return answer.rendered(docs, question), []

    norms = spark.createDataFrame([], schema.NORM)
    placed = answer.with_context(old, nodes, norms)
    shown = {r.query_id: r.answer for r in answer.answer(asked, placed, Watched(), "2010-01-01").collect()}
    assert f"fonte: {schema.CATALOGUE[0][3]} | id: {CF}!art6@2>" in shown[2] and 'title="Constituição Federal de 1988, Art. 6º"' in shown[2] and shown[2].endswith("moradia educação")
    dated = answer.requests(asked.withColumn("date", F.when(F.col("query_id") == 1, "2010-01-01").otherwise("2011-02-03")), old, answer.Extractive()).collect()
    assert {r.query_id: r.request_sha for r in dated}[1] == rows[1].request_sha != rows[2].request_sha and "2011-02-03" in {r.query_id: r.system for r in dated}[2]
    used = answer.cache_use(first, first.where("query_id = 1")).first()
    assert (used.requests, used.stored, used.sent) == (2, 1, 1)

    again = answer.answer(asked, old, Unused(), "2010-01-01", cache=first)
    assert {r.query_id: r.answer for r in again.collect()} == {k: r.answer for k, r in rows.items()}

    class Other(answer.Extractive):
        name = "other"

        def generate(self, *_):
            return "from another backend", []

    assert {r.answer for r in answer.answer(asked, old, Other(), "2010-01-01", cache=first).collect()} == {"from another backend"}
    for bad in (("ab", "2020-01-01", 5), ("abc", None, 5), ("abc", "2020-01-01", 21)):
        with pytest.raises(ValueError):
            answer.check_question(*bad)


def test_stream_replaces_norms(spark, tmp_path):
    store, folder = Store(spark, f"file://{tmp_path}/store"), tmp_path / "in"
    folder.mkdir()
    line = lambda text, at: json.dumps({"norm_urn": CDC, "published": "1990-09-11", "html": text, "at": at})
    (folder / "1.json").write_text(line("<p>Art. 1º um</p>", "2024-01-01T00:00:00Z"))
    for n, text in ((1, "um"), (2, "dois")):
        if n == 2:
            (folder / "2.json").write_text(line("<p>Art. 1º dois</p>", "2024-01-02T00:00:00Z"))
        ingest_stream(spark, str(folder), store, f"{tmp_path}/cp").awaitTermination()
        assert [r.text for r in store.read("provision").collect()] == [text]
    assert store.norms_indexed().count() == 1
