"""Runs over annotated questions: each at its date, abstention items in no mean, costs before anything is sent."""

import datetime

import pytest
from pyspark.sql import functions as F

from quarry import schema
from quarry.operators import search
from quarry.plans import answer, gold_run

D = datetime.date
OLD, NEW = ("n!art1@1", D(1990, 1, 1), D(2010, 1, 1)), ("n!art1", D(2010, 1, 1), None)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("gold")

    def stored(df, name):
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    rows = [(1, *OLD, "aluguel de casas antigo"), (2, *NEW, "aluguel de casas novo"), (3, "n!art2", D(1990, 1, 1), None, "garantia de produtos")]
    nodes = stored(spark.createDataFrame(rows, "chunk_no long, id string, valid_from date, revoked_on date, text string").select(
        "chunk_no", "id", F.lit("n").alias("norm_urn"), F.substring_index("id", "!", -1).alias("path"), F.lit(None).cast("string").alias("parent_path"), F.lit("artigo").alias("type"), F.concat(F.lit("Art. "), F.substring("id", 6, 1)).alias("label"), F.lit(1).alias("ordinal"), "text", "valid_from", "revoked_on"), "nodes")
    chunks = nodes.withColumnRenamed("id", "provision_id")
    encode = search.hashed_encoder(16)
    vectors = stored(chunks.select("chunk_no", encode("text").cast("array<double>").alias("vector")), "vectors")
    gold = [("a", "vig", "aluguel de casas", D(2005, 1, 1), ["n!art1@1"], False), ("b", "vig", "aluguel de casas", D(2015, 1, 1), ["n!art1"], False), ("c", "amb", "garantia de produtos", D(2015, 1, 1), ["n!art2", "n!art9"], False), ("d", "abs", "receita de bolo", D(2015, 1, 1), [], True)]
    frame = spark.createDataFrame(gold, "id string, mecanismo string, pergunta string, data_referencia date, dispositivos_esperados array<string>, deve_abster boolean")
    asked = stored(gold_run.questions(frame, encode), "asked")
    passages = stored(answer.retrieve(asked.select("query_id", "text", "date", "vector"), chunks, vectors, nodes), "passages")
    return asked, chunks, vectors, nodes, passages


def test_each_item_is_asked_at_its_date(world):
    asked, chunks, vectors, nodes, passages = world
    shown = {(r.item, p) for r in passages.join(asked.select("query_id", "item"), "query_id").collect() for p in r.provisions}
    assert {("a", "n!art1@1"), ("b", "n!art1")} <= shown and not {("a", "n!art1"), ("b", "n!art1@1")} & shown
    rows = {r.item: r for r in gold_run.retrieval(asked, chunks, vectors, nodes, ks=(1, 5)).collect()}
    assert rows["a"].recall_1 == rows["b"].recall_1 == 1.0 and (rows["c"].recall_5, rows["c"].missing) == (0.5, ["n!art9"])
    assert rows["d"].should_abstain and rows["d"].recall_5 == 1.0 and rows["a"].missing == []


def test_abstention_items_are_in_no_mean(world):
    asked, *_, passages = world
    means = {(r.level, r.mechanism): (r["items"], r.recall_5, r.mrr) for r in gold_run.report(gold_run.measured(asked, passages)).collect()}
    assert means == {("all", None): (3, 0.833333, 1.0), ("group", "vig"): (2, 1.0, 1.0), ("group", "amb"): (1, 0.5, 1.0)}


def test_costs_are_known_before_anything_is_sent(spark, world):
    asked, *_, passages = world
    backend = answer.Extractive()
    sent = answer.requests(asked, passages.where(F.col("query_id") != F.xxhash64(F.lit("d"))), backend)
    cache = sent.where(F.col("query_id") == F.xxhash64(F.lit("c"))).select("request_sha", F.lit(backend.name).alias("backend"), F.lit("x").alias("answer"), F.array().cast("array<struct<ref: string, quoted: string, from: long, to: long>>").alias("quotes"))
    prices = spark.createDataFrame([("m", 3.0, 15.0)], "prefix string, input double, output double")
    row = gold_run.estimate(sent, cache, backend, "m-1", prices).first()
    characters = sum(r.characters // 3 for r in sent.collect() if r.query_id in {q.query_id for q in asked.where("item IN ('a', 'b')").collect()})
    assert (row.questions, row.no_candidates, row.stored, row.payable) == (4, 1, 1, 2)
    assert row.least_cost == pytest.approx((3 * characters + 15 * 2 * 500) / 1e6) and row.most_cost == pytest.approx((3 * characters + 15 * 2 * 8192) / 1e6)
    assert gold_run.estimate(sent, cache, backend, "unknown", prices).first().least_cost is None
    other = cache.withColumn("backend", F.lit("other"))
    assert gold_run.estimate(sent, other, backend, "m", prices).first().payable == 3
    assert tuple(gold_run.estimate(sent.limit(0), cache, backend, "m", prices).first()) == (0, 0, 0, 0, 0.0, 0.0)


def test_answers_are_measured(spark, world):
    asked, _, _, nodes, passages = world
    backend = answer.Extractive()
    answers = answer.answer(asked, passages, backend)
    ids = asked.select("query_id", F.explode(F.when(F.col("item") == "a", F.array(F.lit("n!art1_par1"), F.lit("n!art10"))).when(F.col("item") == "b", F.array(F.lit("n!art1")))).alias("id"))
    row = gold_run.answers_measured(asked, answers, ids, backend).first()
    assert row["items"] == 4 and row.accuracy == pytest.approx((0.5 + 1.0 + 0.0) / 3, abs=1e-6)

    class Plain(answer.Extractive):
        name, native_citations = "plain", False

    with pytest.raises(ValueError, match="plain"):
        gold_run.answers_measured(asked, answers, ids, Plain())
    named = {r.id: (r.full_label, r.source_url) for r in answer.with_names(spark.createDataFrame([("n!art2",), ("gone",)], "id string"), nodes, spark.createDataFrame([], schema.NORM)).collect()}
    assert named["n!art2"][0].endswith("Art. 2") and named["n!art2"][1] == "" and named["gone"] == (None, None)


def test_a_run_counts_its_calls(spark, world, tmp_path):
    asked, _, _, nodes, passages = world
    prices = spark.createDataFrame([("m", 3.0, 15.0)], "prefix string, input double, output double")
    lines = passages.select("query_id", F.concat(F.lit("D"), F.col("rank")).alias("ref"), F.element_at("provisions", 1).alias("id"), F.lit(0).alias("start"), F.length("text").alias("end"))
    shown, lines = (df.where(F.col("query_id") != F.xxhash64(F.lit("d"))) for df in (passages, lines))

    class Failing(answer.Extractive):
        def generate(self, system, documents, question):
            if "garantia" in question:
                raise schema.BackendFailed(question)
            return super().generate(system, documents, question)

    with pytest.raises(Exception, match="garantia"):
        answer.answer(asked, shown, Failing()).collect()
    row = gold_run.end_to_end(asked, shown, lines, Failing(), "m-1", prices, f"{tmp_path}/one", tolerant=True).first()
    assert (row.questions, row.no_candidate_questions, row.stored, row.sent, row.failed_calls) == (4, 1, 0, 3, 1)
    assert (row["items"], row.answered, row.failed, row.abstained, row.abstained_rightly, row.abstained_wrongly) == (4, 0.5, 0.25, 0.25, 1.0, 0.0)
    assert row.cost > 0
    # what was answered is not paid again; what failed is
    cache = spark.read.parquet(f"{tmp_path}/one").where("answer IS NOT NULL AND request_sha IS NOT NULL")
    again = gold_run.end_to_end(asked, shown, lines, answer.Extractive(), "m-1", prices, f"{tmp_path}/two", cache=cache).first()
    assert (again.stored, again.sent, again.failed_calls, again.answered) == (2, 1, 0, 0.75) and 0 < again.cost < row.cost
    full = spark.read.parquet(f"{tmp_path}/two").where("request_sha IS NOT NULL")
    last = gold_run.end_to_end(asked, shown, lines, answer.Extractive(), "unknown", prices, f"{tmp_path}/three", cache=full).first()
    assert (last.sent, last.cost) == (0, 0.0)
    assert gold_run.end_to_end(asked, shown, lines, answer.Extractive(), "unknown", prices, f"{tmp_path}/four").first().cost is None
