"""The exact vector index against exhaustive search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import search
from quarry.plans import vectors
from quarry.plans.vectors import VectorIndex


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(12, 16))
    points = [(i, (middle[i % 12] + 0.15 * rng.normal(size=16)).tolist()) for i in range(600)]
    points += [(600 + i, points[5][1]) for i in range(40)] + [(700, [0.0] * 16), (701, [0.0] * 16), (702, None)]
    return points


@pytest.mark.parametrize("k", [1, 10, 700])
def test_same_rows_as_exhaustive_search(spark, rows, k):
    table = frame(spark, rows)
    asked = table.where("id % 40 = 0 OR id = 700").withColumnRenamed("id", "query_id")
    index = VectorIndex.build(table, parts=24)
    found = index.search(asked, k)
    want = search.cosine(asked.where("vector IS NOT NULL"), table.where("vector IS NOT NULL"), k)
    key = lambda r: (r.query_id, r.rank, r.id, round(r.score, 6))
    assert sorted(map(key, found.collect())) == sorted(map(key, want.collect()))
    assert (0 < index.compared < 0.4) if k == 10 else index.compared <= 1


def test_bounds_hold(rows):
    m = vectors.unit(np.array([v for _, v in rows if v and any(v)]))
    centres = vectors.centres_of(m, 9)
    home = (m @ centres.T).argmax(axis=1)
    parts = np.unique(home)
    radii = np.array([np.arccos(np.clip((m[home == p] @ centres[p]), -1, 1)).max() for p in parts])
    index = VectorIndex(None, centres, parts, radii, np.bincount(home)[parts])
    bound = index.bounds(m)
    for at, p in enumerate(parts):
        assert (bound[:, at] >= (m @ m[home == p].T).max(axis=1) - 1e-6).all()


def test_empty_tables(spark, rows):
    table = frame(spark, rows)
    none = table.where(F.lit(False))
    assert VectorIndex.build(none).search(table.where("id < 3").withColumnRenamed("id", "query_id"), 5).collect() == []
    assert VectorIndex.build(table, parts=4).search(none.withColumnRenamed("id", "query_id"), 5).collect() == []
