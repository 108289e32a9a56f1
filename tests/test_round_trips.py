import datetime

from pyspark.sql import functions as F
from quarry.operators import cite, evaluate, lookup, search
from quarry.plans import answer
from quarry.sources.store import Store
from quarry.streaming.ingest import replace_batch

DAY = datetime.date(2000, 1, 1)
URN = "urn:lex:br:federal:lei:2000-01-01;1"


def test_links_of_a_replaced_norm_go(spark, tmp_path):
    store, run = Store(spark, f"file://{tmp_path}"), None
    run = replace_batch(store)
    page = lambda *texts: "".join(f"<p>{t}</p>" for t in texts)
    batch = lambda n, html: spark.createDataFrame([(URN, DAY, html, datetime.datetime(2020, 1, n))], "norm_urn string, published date, html string, at timestamp")
    run(batch(1, page("Art. 1º Primeiro.", "Art. 2º Na forma do art. 1º, algo.")), 0)
    assert [(r.origin_id, r.resolved) for r in store.read("xref").collect()] == [(f"{URN}!art2", True)]
    run(batch(2, page("Art. 1º Primeiro.", "Art. 2º Nada mais.")), 1)
    assert store.read("xref").count() == 0 and store.read("provision").count() == 2
    run(batch(3, page("Prosa sem artigos.")), 2)
    assert store.read("provision").count() == 0


def test_an_item_that_expects_nothing_found_all(spark):
    expected = spark.createDataFrame([("a", "x")], "item string, expected string")
    ranked = spark.createDataFrame([("a", 2, "x")], "item string, position int, covered string")
    items = spark.createDataFrame([("a",), ("b",)], "item string")
    got = {r.item: r for r in evaluate.with_nothing_expected(evaluate.recall_and_mrr(evaluate.hits(expected, ranked)), items).collect()}
    assert got["a"].mrr == 0.5 and got["b"].mrr == got["b"].recall_5 == 1.0


def test_citation_accuracy_and_abstention(spark):
    items = spark.createDataFrame([("a",), ("b",)], "item string")
    cited = spark.createDataFrame([("a", "n!art1@2_inc3"), ("a", "n!art1_inc3"), ("a", "n!art10")], "item string, cited string")
    expected = spark.createDataFrame([("a", "n!art1")], "item string, expected string")
    got = {r.item: (r.cited, r.right, r.accuracy) for r in evaluate.citation_accuracy(cited, expected, items).collect()}
    assert got == {"a": (3, 2, 0.666667), "b": (0, 0, 0.0)}  # each citation counts, none is worth nothing
    rows = spark.createDataFrame([(True, True), (True, False), (False, False), (False, True), (False, False)], "should boolean, abstained boolean")
    r = evaluate.abstention(rows).first()
    assert (r.abstained_rightly, r.abstained_wrongly, r.agreement) == (0.5, 0.333333, 0.6)


def test_the_longest_prefix_prices_a_model(spark):
    prices = spark.createDataFrame([("m", 1.0, 1.0), ("m-large", 9.0, 9.0)], "prefix string, input double, output double")
    calls = spark.createDataFrame([("m-large-2", 1), ("m-small", 1), ("x", 1), ("m-small", 1)], "model string, n int")
    got = sorted((r.model, r.input_price) for r in evaluate.price(prices, calls).collect())
    assert got == [("m-large-2", 9.0), ("m-small", 1.0), ("m-small", 1.0), ("x", None)]


def test_short_quotations_are_found(spark):
    texts = spark.createDataFrame([(1, "the reworded passage of a text"), (2, "nothing here"), (3, "two re word")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "word"), (2, "ed pass"), (3, "reworded passage of"), (4, " here"), (5, "absent"), (6, " ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in cite.contained(texts, quotes).collect()}
    assert got == {(1, 1), (3, 1), (1, 2), (1, 3), (2, 4)}


def test_each_question_at_its_own_date(spark):
    chunks = spark.createDataFrame(
        [(1, "n!art1@1", "n", "art1@1", "artigo", "old rule about houses", DAY, datetime.date(2010, 1, 1)), (2, "n!art1", "n", "art1", "artigo", "new rule about houses", datetime.date(2010, 1, 1), None)],
        "chunk_no long, provision_id string, norm_urn string, path string, type string, text string, valid_from date, revoked_on date",
    )
    nodes = chunks.select(F.col("provision_id").alias("id"), "norm_urn", "path", F.lit(None).cast("string").alias("parent_path"), "type", F.lit("Art. 1").alias("label"), F.lit(1).alias("ordinal"), "text", "valid_from", "revoked_on")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "chunk_no long, vector array<double>")
    asked = spark.createDataFrame([(7, "rule about houses", [1.0, 0.0], datetime.date(2005, 1, 1)), (8, "rule about houses", [1.0, 0.0], datetime.date(2015, 1, 1))], "query_id long, text string, vector array<double>, date date")
    got = {r.query_id: r.provisions for r in answer.retrieve(asked, chunks, vectors, nodes).collect()}
    assert got == {7: ["n!art1@1"], 8: ["n!art1"]}


def test_answers_end_in_provisions(spark):
    answers = spark.createDataFrame([(1, [("D1", "line two", 9, 17), ("D1", "made up", 0, 7), ("D9", "x", 0, 1)])], "query_id long, quotes array<struct<ref: string, quoted: string, from: long, to: long>>")
    passages = spark.createDataFrame([(1, 1, "line one\nline two")], "query_id long, rank int, text string")
    lines = spark.createDataFrame([(1, "D1", "n!art1", 0, 8), (1, "D1", "n!art2", 9, 17)], "query_id long, ref string, id string, start long, end long")
    assert [(r.span_id, r.id) for r in answer.cited(answers, passages, lines).collect()] == [(0, "n!art2")]


def test_lookups(spark):
    rows = spark.createDataFrame([("n!art1",), ("n!art1@2",), ("n!art1@1",), ("n!art1_inc2",), ("n!art10",)], "id string")
    wanted = spark.createDataFrame([("n!art1",)], "id string")
    assert [r.id for r in lookup.wordings(rows, wanted).orderBy("nth").collect()] == ["n!art1@1", "n!art1@2", "n!art1"]
    assert {r.id for r in lookup.below(rows, wanted.withColumnRenamed("id", "prefix")).collect()} == {"n!art1", "n!art1_inc2"}
    assert lookup.without(rows, wanted, "id").count() == 4 and lookup.hydrate(wanted.withColumn("rank", F.lit(1)), rows).count() == 1
