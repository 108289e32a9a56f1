"""BM25 in blocks: what is scored, and what is never a row."""

import random

from pyspark.sql import functions as F

from quarry.operators import search


def _texts(rows, seed):
    rng = random.Random(seed)
    words = ["de", "a", *("".join(rng.choices("abcdefgh", k=3)) for _ in range(40))]
    return [(i, " ".join(rng.choices(words, weights=[40, 30, *[1] * 40], k=rng.randint(0, 12)))) for i in range(rows)]


def test_blocks_give_what_all_pairs_give(spark, monkeypatch):
    for name, value in (("CELL", 60), ("ASKED", 20), ("DOCUMENTS", 8), ("QUERIES", 4)):
        monkeypatch.setattr(search, name, value)
    texts = _texts(90, 1)
    docs = spark.createDataFrame(texts + [(i + 100, t) for i, t in texts[:30]] + [(5, "de aaa"), (300, None)], "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([*_texts(12, 2), (50, None), (51, "nowhere")], "query_id long, text string")
    terms = search.asked_terms(asked)
    pairs = search.bm25(asked, search.postings(docs), 122, k=7, allowed=F.lit(True))
    best = search.bm25(asked, search.packed(docs, terms), 122, k=7)
    assert best.count() > 50
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, pairs.select(*best.columns).collect()))
    assert sorted(map(tuple, search.bm25(asked, search.postings(docs), 122, k=7).collect())) == sorted(map(tuple, best.collect()))


def test_pairs_that_share_a_term_are_not_shuffled(spark):
    """One word in every text: its pairs grow with the square of the rows."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("de "), F.chr(F.col("id") % 26 + 97)).alias("text"))
    asked = docs.select(F.col("doc_id").alias("query_id"), "text")
    found = search.bm25(asked, search.postings(docs), 40, k=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Join" not in plan.split("FlatMapCoGroupsInPandas")[0]
    assert found.count() == 120


def test_a_group_is_searched_by_itself(spark):
    docs = spark.createDataFrame([(1, "casa verde", "pt"), (2, "casa", "en"), (3, "casa", None)], "doc_id long, text string, group string")
    asked = search.asked_terms(spark.createDataFrame([(7, "casa", "pt"), (8, "casa", None), (9, "verde", "en")], "query_id long, text string, group string"), search.LETTERS, "group")
    found = search.best_of_blocks(asked, search.packed(docs, asked, more=("group",)), 3, 5).collect()
    assert [(r.query_id, r.id, r.rank) for r in found] == [(7, 1, 1)]


def test_a_word_is_folded_once_for_all_texts(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def fold(word):
        calls.add(1)
        return word[:3]

    docs = spark.createDataFrame([(i, "casas casa rua") for i in range(30)], "doc_id long, text string").repartition(3)
    found = search.postings(docs, analysis=search.Analysis("x", search.LETTERS.words, fold)).collect()
    assert sorted({(r.term, r.tf, r.length) for r in found}) == [("cas", 2, 3), ("rua", 1, 3)] and len(found) == 60
    assert calls.value == 3


def test_blocks_of_few_pages_are_held_at_a_time(spark):
    from quarry.sources import html

    pages = spark.createDataFrame([(i, f"<p>a{i}</p><p>b</p>") for i in range(150)], "page_id long, html string").coalesce(1)
    assert html.PAGES < 150
    cut = html.blocks(pages, ["page_id"])
    assert cut.count() == 300 and cut.where("pos = 1 AND text = 'b'").count() == 150


def test_rows_are_not_dealt_by_their_norm(spark):
    """Few norms: a shuffle by norm would bring all rows of one into a task, whatever the size that Spark expects."""
    from quarry import schema
    from quarry.operators import chunk

    nodes = spark.createDataFrame([], schema.PROVISION)
    norms = spark.createDataFrame([], schema.NORM)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = chunk.by_provision(nodes, norms)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [norm_urn" in plan
