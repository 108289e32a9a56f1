import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry.llm import ann


def vectors(n=1500, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.5 * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:400] = x[100]  # one very common vector
    return x


@pytest.mark.parametrize("partitions", [1, 5])
def test_recall_and_order(spark, partitions):
    x = vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0, None] + [0.0] * 14), (9005, [1.0] * 3), (None, x[0].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vector", F.lit("clash")).repartition(partitions)
    got = ann.search(frame, frame.where("vec_id % 20 = 0"), k=20).toPandas().sort_values(["query_id", "rank"])
    found = asked = 0
    for q, own in got.groupby("query_id"):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        top = np.lexsort((np.arange(len(x)), -score))[:20]
        found += len(set(top) & set(own["vec_id"]))
        asked += 20
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own["score"], score[own["vec_id"]], atol=1e-12)
        assert own.sort_values(["score", "vec_id"], ascending=[False, True])["rank"].tolist() == own["rank"].tolist()
        if 100 <= q < 400:
            assert own["vec_id"].tolist() == [i for i in range(100, 122) if i != q][:20]
    assert asked == 20 * 75 and found / asked >= 0.9


@pytest.mark.parametrize("better", [9, 12, 15, 19])
def test_ties_in_the_middle_of_a_list(spark, better):
    dim, n, rng = 8, 1200, np.random.default_rng(better)
    x = rng.normal(size=(n, dim))
    x[:, 0] = -1.0
    order = rng.permutation(n)
    x[order[:300]] = [0.5] + [0.0] * (dim - 1)  # copies of one vector
    x[order[300 : 300 + better], 0] = 1 + np.arange(better)
    queries = [(n + j, [1.0 + j] + [0.0] * (dim - 1)) for j in range(20)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = ann.search(frame, spark.createDataFrame(queries, "vec_id long, embedding array<double>"), k=20, parts=1).orderBy("query_id", "rank").toPandas()
    best = [*order[300 : 300 + better][::-1], *np.sort(order[:300])[: 20 - better]]
    assert got.groupby("query_id")["vec_id"].apply(list).tolist() == [best] * 20


def test_few_and_no_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = ann.search(frame, frame.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 20), (20, 1), (20, 0)]
    assert ann.search(frame.limit(0), frame.limit(0)).count() == 0


def test_parts_are_balanced():
    x = vectors(800)[400:]
    graph = ann.neighbour_graph(x, 10)
    part = ann.balanced_parts(graph, x, 8, np.random.default_rng(0))
    assert np.bincount(part, minlength=8).max() <= 1.1 * len(x) / 8 + 1


def test_recall_and_share_probed_on_embeddings(spark):
    data = "/root/testdata/sf0.1/embeddings.parquet"
    frame = spark.read.parquet(data).select("vec_id", "embedding")
    rows = frame.orderBy("vec_id").toPandas()
    x, ids = np.stack(rows["embedding"].to_numpy()).astype(float), rows["vec_id"].to_numpy()
    queries = np.flatnonzero(ids % 20 == 0)
    got = ann.search(frame, frame.where("vec_id % 20 = 0"), k=20).toPandas().groupby("query_id")["vec_id"].apply(set)
    found = 0
    for q in queries:
        score = x @ x[q]
        score[q] = -np.inf
        found += len(got[ids[q]] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert found / (20 * len(queries)) >= 0.9
    router = ann.fit(np.unique(x, axis=0)[np.random.default_rng(1).permutation(len(np.unique(x, axis=0)))], 8)
    home = np.bincount(router.home(x)[1], minlength=8)
    row, part = router.probed(x[queries])
    share = home[part].sum() / (len(x) * len(queries))
    print("share of the rows compared", share)
    assert share < 0.9


def test_repeated_ids_keep_the_least_vector(spark):
    rows = [(0, [1.0, 0.0]), (1, [5.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.7, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.search(frame, frame.where("vec_id = 0"), k=2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 0.7), (1, 0.5)]
