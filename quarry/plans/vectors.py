"""An exact vector index: parts with a centre and a radius, of which a query skips those that cannot matter.

Vectors are points on the unit sphere.  Angles obey the triangle inequality, so
no vector of a part is nearer to a query than the angle to the part's centre
less the part's radius.  A query first searches the nearest parts that hold
enough vectors; the k-th score found there is a lower bound of the k-th score
of all, and of the other parts only those are searched whose bound reaches it.
The rows are those of an exhaustive search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.ordered import top_k
from quarry.sources.store import Store

#: Vectors that centres are set by, and vectors of a part that are aimed at, both bounds of what the driver and a task hold.
SAMPLE_ROWS, PART_ROWS, MOST_PARTS, BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096, 1024, 8192, 1024
#: Scores are rounded to 6 digits: a bound must lie below a score by more than that, and than the rounding of angles.
SLACK = 2e-6
DIGITS = 6
ZERO = -1  #: the part of vectors of length zero, whose score is 0 with any query


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def centres_of(sample: np.ndarray, parts: int, seed: int = 7, rounds: int = 8) -> np.ndarray:
    """Spherical k-means over unit vectors: centres of ``parts`` parts at most."""
    sample = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:parts]]
    for _ in range(rounds):
        home = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        filled = np.linalg.norm(sums, axis=1) > 1e-9
        centres = np.where(filled[:, None], unit(sums), centres)
    return centres


@dataclass
class VectorIndex:
    """rows: part, id, vector (unit); centres and radii of the parts, and how many rows each has."""

    rows: DataFrame
    centres: np.ndarray
    parts: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    compared: float = 0.0  #: share of all pairs of the last search that were compared

    @staticmethod
    def build(vectors: DataFrame, parts: int | None = None, seed: int = 7) -> VectorIndex:
        """Index of vectors (id, vector): all rows, in parts set by a bounded sample.

        Vectors have one dimension and finite components; null ones take no part.
        """
        spark, given = vectors.sparkSession, vectors.where(F.col("vector").isNotNull()).select("id", F.col("vector").cast("array<double>").alias("vector"))
        n = given.count()
        store = Store.scratch(spark)
        share = min(1.0, 2 * SAMPLE_ROWS / max(1, n))
        mark = F.xxhash64(F.lit(seed), "id")
        near = given.withColumn("_m", mark).where(F.pmod("_m", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("_m", "id").limit(SAMPLE_ROWS).select("vector").collect()
        sample = unit(np.array([r["vector"] for r in near], np.float64)) if near else np.zeros((0, 1))
        sample = sample[np.abs(sample).sum(axis=1) > 0]
        wanted = parts or max(1, min(MOST_PARTS, -(-n // PART_ROWS)))
        centres = centres_of(sample, wanted, seed) if len(sample) else np.zeros((0, sample.shape[1]))
        shared = spark.sparkContext.broadcast(centres)  # MOST_PARTS vectors at most

        def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    m = unit(np.stack(batch["vector"].to_numpy()).astype(np.float64))
                    own = m @ shared.value.T if len(shared.value) else np.zeros((len(m), 1))
                    part = np.where(np.abs(m).sum(axis=1) > 0, own.argmax(axis=1), ZERO)
                    yield pd.DataFrame({"part": part, "id": batch["id"], "vector": list(m), "away": np.arccos(np.clip(own.max(axis=1), -1, 1))})

        store.rewrite("vectors", given.mapInPandas(home, "part int, id long, vector array<double>, away double"))
        rows = store.read("vectors")
        known = rows.groupBy("part").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row for each part
        number = np.array([r["part"] for r in known], np.int64)
        return VectorIndex(rows.drop("away"), centres, number, np.array([r["radius"] for r in known]), np.array([r["n"] for r in known], np.int64))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and part, no less than the cosine with any of its vectors."""
        out = np.zeros((len(queries), len(self.parts)))
        filled = self.parts != ZERO
        if filled.any():
            angle = np.arccos(np.clip(queries @ self.centres[self.parts[filled]].T, -1, 1))
            out[:, filled] = np.cos(np.maximum(angle - self.radii[filled] - 1e-7, 0))
        out[np.abs(queries).sum(axis=1) == 0] = 0.0
        return out

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank): the k vectors of the largest cosine with each of queries (query_id, vector), ties by the smaller id."""
        spark, store = self.rows.sparkSession, Store.scratch(self.rows.sparkSession)
        asked = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        index = VectorIndex(None, self.centres, self.parts, self.radii, self.sizes)

        def routed(first: bool):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    if not len(batch) or not len(index.parts):
                        continue
                    m = unit(np.stack(batch["vector"].to_numpy()).astype(np.float64))
                    bound = index.bounds(m)
                    order = np.argsort(-bound, axis=1, kind="stable")
                    before = np.cumsum(index.sizes[order], axis=1) - index.sizes[order]
                    opens = np.zeros(bound.shape, bool)
                    np.put_along_axis(opens, order, before < k, 1)  # the nearest parts, until they hold k vectors
                    if not first:
                        opens = ~opens & (bound >= batch["least"].fillna(-2.0).to_numpy()[:, None] - SLACK)
                    row, part = np.nonzero(opens)
                    if len(row):
                        yield pd.DataFrame({"part": index.parts[part], "query_id": batch["query_id"].to_numpy()[row], "q": [m[i] for i in row]})

            return run

        kind = "part int, query_id long, q array<double>"
        store.rewrite("first", self._best(asked.mapInPandas(routed(True), kind), k))
        first = store.read("first")
        least = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        store.rewrite("second", asked.join(least, "query_id", "left").mapInPandas(routed(False), kind))
        more = store.read("second")
        held = spark.createDataFrame([(int(p), int(n)) for p, n in zip(self.parts, self.sizes, strict=True)], "part int, n long")
        pairs = more.join(F.broadcast(held), "part").agg(F.sum("n")).first()[0] or 0
        every = asked.count() * int(self.sizes.sum())
        opened = asked.mapInPandas(routed(True), kind).join(F.broadcast(held), "part").agg(F.sum("n")).first()[0] or 0
        self.compared = (pairs + opened) / every if every else 0.0
        both = first.select("query_id", "id", "score").unionByName(self._best(more, k).select("query_id", "id", "score"))
        return top_k(both, ["query_id"], [F.desc("score"), F.asc("id")], k).select("query_id", "id", "score", "rank")

    def _best(self, probes: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank): the k best of the parts that each query probes; parts meet queries block by block."""
        spark = self.rows.sparkSession
        asked = {r["part"]: r["n"] for r in probes.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each part
        blocks = [(int(p), -(-int(n) // BLOCK_ROWS), -(-asked.get(int(p), 0) // BLOCK_QUERIES)) for p, n in zip(self.parts, self.sizes, strict=True) if asked.get(int(p))]
        grid = F.broadcast(spark.createDataFrame(blocks, "part int, row_blocks long, query_blocks long"))
        pick = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = self.rows.join(grid, "part").select("part", pick("id", "row_blocks").alias("rb"), each("query_blocks").alias("qb"), "id", "vector")
        right = probes.join(grid, "part").select("part", each("row_blocks").alias("rb"), pick("query_id", "query_blocks").alias("qb"), "query_id", "q")

        def compare(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})]
            if len(own) and len(ask):
                own = own.sort_values("id", kind="stable")
                ids, m, q, names = own["id"].to_numpy(), np.stack(own["vector"].to_numpy()), np.stack(ask["q"].to_numpy()), ask["query_id"].to_numpy()
                for at in range(0, len(q), 256):
                    near = np.round(q[at : at + 256] @ m.T, DIGITS) + 0.0
                    best = np.argsort(-near, axis=1, kind="stable")[:, :k]
                    out.append(pd.DataFrame({"query_id": np.repeat(names[at : at + 256], best.shape[1]), "id": ids[best].ravel(), "score": np.take_along_axis(near, best, 1).ravel()}))
            return pd.concat(out)

        keys = ["part", "rb", "qb"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, id long, score double")
        return top_k(found, ["query_id"], [F.desc("score"), F.asc("id")], k)
