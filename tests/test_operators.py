import datetime
import random

import pytest
from pyspark.sql import functions as F
from quarry.operators import chunk, cite, evaluate, expand, search, temporal, tree

NORM = "urn:lex:br:federal:lei:1990-09-11;8078"
D = datetime.date


def provisions(spark):
    rows = [
        ("tit1", "titulo", "Título I", "Dos Direitos", 1, None, None),
        ("tit1/cap3", "capitulo", "Capítulo III", "Dos Direitos Básicos", 1, None, None),
        ("tit1/cap3/art6", "artigo", "Art. 6º", "São direitos básicos do consumidor:", 1, None, None),
        ("tit1/cap3/art6/inc10", "inciso", "X", "a adequada e eficaz prestação dos serviços", 10, None, None),
        ("tit1/cap3/art6/inc2", "inciso", "II", "a educação e divulgação sobre o consumo", 2, None, None),
        ("tit1/cap3/art6/inc8", "inciso", "VIII", "a facilitação da defesa de seus direitos", 8, None, None),
        ("tit1/cap3/art6/inc4", "inciso", "IV", "inciso hipotético revogado", 4, None, D(2020, 1, 1)),
        ("tit1/cap3/art6/inc11", "inciso", "XI", "só entra em vigor em 2030", 11, D(2030, 1, 1), None),
    ]
    data = [(f"{NORM}!{p}", NORM, p, t, lab, txt, o, a, b) for p, t, lab, txt, o, a, b in rows]
    return spark.createDataFrame(data, "id string, norm_urn string, path string, type string, label string, text string, ordinal int, valid_from date, revoked_on date")


@pytest.mark.parametrize("at, gone", [("2026-01-01", {"inc4", "inc11"}), ("2019-12-31", {"inc11"}), ("2020-01-01", {"inc4", "inc11"}), ("2030-01-01", {"inc4"})])
def test_windows_are_half_open(spark, at, gone):
    nodes = provisions(spark)
    alive = {r.path.rpartition("/")[2] for r in nodes.where(temporal.in_force(F.lit(at).cast("date"))).collect()}
    assert {"inc4", "inc11"} - alive == gone
    kept = nodes.where(temporal.in_force(F.lit("2026-01-01").cast("date"), include_revoked=True)).count()
    assert kept == 7


def test_as_of_join_against_brute_force(spark):
    rnd = random.Random(1)
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rnd.randrange(24 * 60))
    probes = [(i, rnd.choice(["a", "b", "c", None]), rnd.choice([at(), at(), None])) for i in range(200)]
    versions = [(rnd.choice(["a", "b", None]), at(), i) for i in range(80)]
    got = temporal.as_of_join(spark.createDataFrame(probes, "p long, k string, t timestamp"), spark.createDataFrame(versions, "k string, s timestamp, v long"), ["k"], "t", "s", ["v"], ["v"], bucket_days=3)
    found = {r.p: r.v for r in got.collect()}
    for p, k, t in probes:
        fits = [(s, v) for key, s, v in versions if key == k and k is not None and t is not None and s <= t]
        assert found[p] == (max(fits)[1] if fits else None)


def test_document_order_and_gaps(spark):
    nodes = provisions(spark).where("path <> 'tit1/cap3'")
    order = [r.path for r in tree.document_order(nodes, ["norm_urn"]).orderBy("doc_key").collect()]
    assert order.index("tit1/cap3/art6/inc2") < order.index("tit1/cap3/art6/inc10")
    first = tree.document_order(nodes, ["norm_urn"]).where("path = 'tit1/cap3/art6'").first()
    assert len(first.doc_key) == 1  # its parent is missing, so it starts a tree of its own


def test_ancestors_subtree_and_nearest(spark):
    nodes = provisions(spark)
    up = tree.ancestors(nodes, ["norm_urn"]).where("path = 'tit1/cap3/art6/inc8'").orderBy("distance").collect()
    assert [r.ancestor for r in up] == ["tit1/cap3/art6", "tit1/cap3", "tit1"]
    assert tree.subtree(nodes, nodes.where("path = 'tit1/cap3/art6'"), scope=["norm_urn"]).count() == 5
    nearest = {r.path: r.nearest for r in tree.nearest_of_type(nodes, ["artigo"], ["norm_urn"]).collect()}
    assert nearest["tit1/cap3/art6/inc8"] == nearest["tit1/cap3/art6"] == "tit1/cap3/art6" and nearest["tit1"] is None


def test_pruning_hangs_children_higher(spark):
    rows = [("tit1", "titulo"), ("tit1/cap1", "capitulo"), ("tit2", "titulo"), ("tit1/cap1/art1", "artigo"), ("tit2/par1", "paragrafo")]
    nodes = spark.createDataFrame(rows, "path string, type string")
    got = {r.path: r.parent_path for r in tree.prune_empty(nodes, F.col("type").isin("titulo", "capitulo"), F.col("type") == "artigo").collect()}
    assert got == {"tit1": None, "tit1/cap1": "tit1", "tit1/cap1/art1": "tit1/cap1", "tit2/par1": None}


def hits(spark, *paths):
    rows = [(1, NORM, f"tit1/cap3/{p}", i + 1, s, None) for i, (p, s) in enumerate(paths)]
    return spark.createDataFrame(rows, "query_id long, norm_urn string, path string, rank int, score double, rerank_score double")


def test_expansion_to_the_article(spark):
    got = expand.expand(hits(spark, ("art6/inc8", 0.3), ("art6/inc2", 0.9)), provisions(spark), F.lit("2026-01-01").cast("date")).collect()
    assert len(got) == 1 and got[0].score == 0.9
    assert [i.rpartition("/")[2] for i in got[0].provisions] == ["art6", "inc2", "inc8", "inc10"]
    assert got[0].text.split("\n")[1] == "II - a educação e divulgação sobre o consumo"


def test_expansion_within_a_budget(spark):
    got = expand.expand(hits(spark, ("art6/inc8", 0.3)), provisions(spark), F.lit("2026-01-01").cast("date"), limit=100).first()
    assert "VIII - " in got.text and "X - a adequada" not in got.text and expand.MARK in got.text
    alone = expand.expand(hits(spark, ("art6", 0.3)), provisions(spark), F.lit("2026-01-01").cast("date"), level="none").first()
    assert alone.text == "Art. 6º São direitos básicos do consumidor:"


def test_offsets_follow_the_passage(spark):
    lines = spark.createDataFrame([(1, i, "x" * (5 + i), i in (0, 3, 4)) for i in range(6)], "g int, o int, line string, kept boolean")
    marked = expand.with_offsets(expand.with_marks(lines, ["g"], ["o"]), ["g"], ["o"]).orderBy("o").collect()
    text = expand.passages(expand.with_marks(lines, ["g"], ["o"]), ["g"], ["o"]).first().text
    assert [text[r.start : r.end] for r in marked] == [r.line for r in marked]
    assert [r.mark_before for r in marked] == [False, True, False]


def test_quotations_find_their_provision(spark):
    text = "Art. 1 head\n[…]\nI - first item\nII - second"
    passages = spark.createDataFrame([(1, "D1", text)], "query_id long, ref string, text string")
    lines = spark.createDataFrame([(1, "D1", "art1", 0, 11), (1, "D1", "inc1", 16, 30), (1, "D1", "inc2", 31, 42)], "query_id long, ref string, id string, start long, end long")
    q = [(1, 1, "D1", text[8:25], 8, 25), (1, 2, "D1", "[…]", 12, 15), (1, 3, "D1", "wrong", 0, 5), (1, 4, "D9", "x", 0, 1), (1, 5, "D1", "whole", None, None)]
    quotes = spark.createDataFrame(q, "query_id long, span_id long, ref string, quoted string, from long, to long")
    assert {r.span_id: r.id for r in cite.resolve(quotes, passages, lines).collect()} == {1: "inc1", 5: None}
    row = spark.range(1).select(cite.anchors(F.lit("a [D2] b [D1] c [D2]")).alias("a"), cite.abstains(F.lit("  sem fundamento nos trechos: x")).alias("b")).first()
    assert row.a == ["D2", "D1"] and row.b


def test_measures(spark):
    expected = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z")], "item long, expected string")
    rankings = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "item long, position int, covered string")
    got = evaluate.recall_and_mrr(evaluate.hits(expected, rankings), (1, 2)).first()
    assert (got.recall_1, got.recall_2, got.mrr) == (0.333333, 0.666667, 1.0)
    assert [r.expected for r in evaluate.missing(evaluate.hits(expected, rankings), 2).collect()] == ["z"]
    price = spark.createDataFrame([("top", 5.0, 25.0)], "prefix string, input double, output double")
    calls = spark.createDataFrame([("top-1", 1_000_000, 1_000_000, 0), ("top-1", 0, 0, 1_000_000), ("other", 1, 1, 0)], "model string, i long, o long, c long")
    cost = evaluate.price(price, calls).withColumn("cost", evaluate.cost(F.col("i"), F.col("c"), F.col("o"), F.col("input_price"), F.col("output_price")))
    assert sorted((r.cost for r in cost.collect()), key=lambda x: (x is None, x)) == [0.5, 30.0, None]
    assert cost.agg(evaluate.total_or_null(F.col("cost")).alias("t")).first().t is None


def test_gold_sets_are_checked(spark):
    gold = spark.createDataFrame(
        [("ok", ["a"], False, D(2024, 1, 1)), ("both", ["a"], True, D(2024, 1, 1)), ("none", [], False, D(2024, 1, 1)), ("absent", ["zz"], False, D(2024, 1, 1)), ("late", ["a"], False, D(1980, 1, 1))],
        "id string, dispositivos_esperados array<string>, deve_abster boolean, data_referencia date",
    )
    known = spark.createDataFrame([("a", D(1990, 1, 1), None)], "base_id string, valid_from date, revoked_on date")
    faults = {(r.id, r.fault) for r in evaluate.validate_gold(gold, known).collect()}
    assert faults == {("both", "contradiction"), ("none", "nothing expected"), ("absent", "not in corpus"), ("late", "not in force")}


def test_fusion_breaks_ties_before_the_cut(spark):
    a = spark.createDataFrame([(1, i, r) for r, i in enumerate([5, 9, 7], 1)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, i, r) for r, i in enumerate([9, 5, 3], 1)], "query_id long, id long, rank int")
    got = search.fuse([a, b], k=1).collect()
    assert [(r.id, r.score) for r in got] == [(5, 0.833333)]


def test_rerank_is_stable_and_replaces_scores(spark):
    rows = spark.createDataFrame([(1, 10, 1, 0.1), (1, 11, 2, 7.5), (1, 12, 3, 0.1)], "query_id long, id long, rank int, s double")
    assert [r.id for r in search.rerank(rows, F.col("s")).orderBy("rank").collect()] == [11, 10, 12]
    same = search.rerank(rows, F.lit(None)).orderBy("rank").collect()
    assert [r.id for r in same] == [10, 11, 12] and all(r.rerank_score is None for r in same)


def test_chunks(spark):
    norms = spark.createDataFrame([(NORM, "CDC", D(1990, 9, 11))], "urn string, alias string, published date")
    by_node = {r.path: r for r in chunk.by_provision(provisions(spark), norms).collect()}
    assert set(by_node) == {f"tit1/cap3/art6{x}" for x in ("", "/inc2", "/inc4", "/inc8", "/inc10", "/inc11")}
    one = by_node["tit1/cap3/art6/inc8"]
    assert one.indexed_text.split("\n")[:2] == ["CDC > Título I — Dos Direitos > Capítulo III — Dos Direitos Básicos", "Art. 6º São direitos básicos do consumidor:"]
    assert one.valid_from_day == D(1990, 9, 11).toordinal() and one.revoked_on_day == 3652059
    article = chunk.strategy("artigo")(provisions(spark), norms).collect()
    assert len(article) == 1 and "IV - " not in article[0].chunk_text and article[0].chunk_id == by_node["tit1/cap3/art6"].chunk_id
    with pytest.raises(ValueError):
        chunk.strategy("x")
