"""Approximate nearest neighbours over learned partitions.

On a bounded sample: a graph of nearest neighbours, cut into balanced parts;
then a small classifier that learns from a vector in which parts its neighbours
lie.  The classifier puts every row into its most probable part, and routes a
query to its several most probable ones, where all rows are ranked by their
exact inner product.  A query probes parts until their probabilities add up to
a mass that is set on held-out queries of the sample, by their recall against
brute force; so a query that the classifier is sure of probes few.

The model alone is fitted on the driver; rows are indexed and searched in
blocks of bounded size, dealt by part, block of rows and block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, written

#: The sample that the index is fitted on: rows at least and at most, rows for each part; and rows of a part that are aimed at.
SAMPLE_ROWS, MOST_SAMPLE_ROWS, SAMPLE_OF_PART, PART_ROWS = 8192, 65_536, 64, 1500
BLOCK_ROWS = 4096


@dataclass
class Router:
    """A two-layer network from vectors to parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.w2 + self.b2

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of each vector, the most probable first, and the probability of all before each."""
        z = self.scores(x)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        order = np.argsort(-z, axis=1, kind="stable")
        own = np.take_along_axis(z, order, 1)
        return order, np.cumsum(own, axis=1) - own

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) of the most probable part of each vector."""
        return np.arange(len(x)), self.scores(x).argmax(axis=1)

    def probed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) of all parts that each query probes, one at least."""
        order, before = self.ranked(x)
        row, place = np.nonzero(before < max(self.mass, 1e-12))
        return row, order[row, place]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the k others of largest inner product."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 256):
        near = x[at : at + 256] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
        out[at : at + 256] = np.take_along_axis(top, order, 1)
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rng: np.random.Generator, sweeps: int = 8, slack: float = 1.1) -> np.ndarray:
    """A part for each node, no part over ``slack`` times its share, with few edges between parts.

    Starts from halves along principal directions, which are balanced, then
    moves single nodes to where most of their neighbours are and room is left.
    """
    part = np.zeros(len(x), np.int64)
    size = 1
    while size < parts:  # split every part in two
        for p in range(size):
            own = np.flatnonzero(part == p)
            centred = x[own] - x[own].mean(axis=0)
            direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = np.argsort(centred @ direction, kind="stable")
            part[own[order[len(own) // 2 :]]] += size
        size *= 2
    both = np.concatenate((np.stack((np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel())), np.stack((graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])))), axis=1)
    both = both[:, np.argsort(both[0], kind="stable")]
    start = np.searchsorted(both[0], np.arange(len(x) + 1))
    room = np.full(parts, int(slack * len(x) / parts) + 1) - np.bincount(part, minlength=parts)
    for _ in range(sweeps):
        moved = 0
        for node in rng.permutation(len(x)):
            near = np.bincount(part[both[1, start[node] : start[node + 1]]], minlength=parts)
            here = part[node]
            to = int(np.where(room > 0, near, -1).argmax())
            if near[to] > near[here]:
                part[node] = to
                room[to] -= 1
                room[here] += 1
                moved += 1
        if moved < len(x) // 200:
            break
    return part


def fit_router(x: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator, hidden: int = 128, epochs: int = 40, rate: float = 3e-3) -> Router:
    """Cross entropy against the share of each part among a vector's own and its neighbours' (``near``, own first); Adam."""
    dim = x.shape[1]
    weight = np.concatenate(([0.2], np.full(near.shape[1] - 1, 0.8 / max(1, near.shape[1] - 1))))
    p = [rng.normal(0, (2 / dim) ** 0.5, (dim, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    scale = np.sqrt((x**2).mean() + 1e-12)
    first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            b = order[at : at + 256]
            xb = x[b] / scale
            h = np.maximum(xb @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = z / z.sum(axis=1, keepdims=True)
            np.subtract.at(dz, (np.arange(len(b))[:, None], near[b]), weight)
            dz /= len(b)
            dh = (dz @ p[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((xb.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Router(p[0] / scale, *p[1:])


def fit(x: np.ndarray, parts: int, k: int = 20, recall: float = 0.93, seed: int = 11) -> Router:
    """Router for the sample ``x`` (distinct rows), the mass it probes set to reach ``recall``."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x) - 1)
    if k < 1 or parts < 2:
        return Router(np.zeros((x.shape[1] if x.ndim == 2 else 1, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x, k)
    part = balanced_parts(graph, x, parts, rng)
    near = np.concatenate((part[:, None], part[graph]), axis=1)
    held = rng.random(len(x)) < 0.1
    epochs = max(10, 40 * 8192 // max(8192, len(x)))
    router = fit_router(x[~held], near[~held], parts, rng, epochs=epochs)
    home = router.home(x)[1]
    needed = []
    for at in np.array_split(np.flatnonzero(held), -(-int(held.sum()) // 1024) or 1):
        order, before = router.ranked(x[at])
        mass = np.empty_like(before)
        np.put_along_axis(mass, order, before, 1)  # of the parts that come before each
        needed.append(np.take_along_axis(mass, home[graph[at]], 1).ravel())
    needed = np.concatenate(needed)
    router.mass = float(np.quantile(needed, recall, method="higher")) + 1e-9 if len(needed) else 1.0
    return router


def valid(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector double[]) without null, zero or non-finite vectors; null ids take no part either."""
    v = F.col("vector")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(vector_column, lambda c: c.cast("double") + F.lit(0.0)).alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda c: c != 0))


def _matrix(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()) if len(column) else np.zeros((0, dim))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, parts: int | None = None, recall: float = 0.93, id_column: str = "vec_id", vector_column: str = "embedding", seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``vectors`` found for each of ``queries``.

    Nearness is the inner product in double precision, ties go to the smaller
    vec_id, and a query's own id is no candidate.  Vectors that are null, zero,
    or hold null or non-finite components take no part, nor do vectors of
    another dimension than the most frequent one.  Of rows with one vector the
    k + 1 of smallest id are candidates: no other can be among the k nearest.
    Rows repeated with one id count once, with the least of their vectors.
    ``parts`` grows with the rows by default, PART_ROWS to each, and the sample
    with the parts, both up to what MOST_SAMPLE_ROWS allow.  ``recall`` is what
    the mass is set for; parts and mass are those of the sample, and the share
    of the rows that is compared follows from how far neighbours lie apart.
    """
    spark = vectors.sparkSession
    base = valid(vectors, id_column, vector_column)
    sizes = base.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = sizes["dim"]
    parts = parts or 1 << max(3, min(int(np.log2(MOST_SAMPLE_ROWS / SAMPLE_OF_PART)), round(np.log2(max(1, sizes["n"] / PART_ROWS)))))
    fits = F.size("vector") == dim
    by_vector = Window.partitionBy("vector").orderBy("vec_id")
    single = lambda df: df.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = single(base.where(fits)).withColumn("_n", F.row_number().over(by_vector)).where(F.col("_n") <= k + 1).drop("_n")
    asked = single(valid(queries, id_column, vector_column).where(fits))
    sample = bounded_sample(base.where(fits), min(MOST_SAMPLE_ROWS, max(SAMPLE_ROWS, SAMPLE_OF_PART * parts)), ["vec_id"], seed).toPandas()
    x = np.unique(_matrix(sample["vector"], dim), axis=0)
    x = x[np.random.default_rng(seed).permutation(len(x))]
    router = fit(x, parts if len(x) >= 4 * parts else 1, k, recall, seed)
    shared = spark.sparkContext.broadcast(router)  # a few 10,000 numbers

    def route(rule: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (batch.slice(at, 1024) for batch in batches for at in range(0, batch.num_rows, 1024)):
                at, part = getattr(shared.value, rule)(_matrix(batch["vector"], dim))
                yield pa.record_batch({"part": pa.array(part, pa.int64()), "vec_id": batch["vec_id"].take(pa.array(at)), "vector": batch["vector"].take(pa.array(at))})

        return run

    routed = "part long, vec_id long, vector array<double>"
    indexed = written(rows.mapInArrow(route("home"), routed), "ann-rows")
    probing = written(asked.mapInArrow(route("probed"), routed), "ann-queries")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        """Rows of each part in blocks by a hash of their id; (part, n): how many blocks."""
        counts = df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("long").alias(name))
        return counts

    n_rows, n_queries = blocks(indexed, "row_blocks"), blocks(probing, "query_blocks")
    grid = F.broadcast(n_rows.join(n_queries, "part"))  # a row for each part
    pick = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = indexed.join(grid, "part").select("part", pick("row_blocks").alias("rb"), each("query_blocks").alias("qb"), "vec_id", "vector")
    right = probing.join(grid, "part").select("part", pick("query_blocks").alias("qb"), each("row_blocks").alias("rb"), "vec_id", "vector")

    def compare(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        """The k best of a block of rows for each query of a block, as one row of lists."""
        out: dict[str, list] = {"query_id": [], "part": [], "far": [], "ids": []}
        if len(own) and len(ask):
            ids, q_ids = own["vec_id"].to_numpy(), ask["vec_id"].to_numpy()
            m, q = _matrix(own["vector"], dim), _matrix(ask["vector"], dim)
            order = np.argsort(ids, kind="stable")
            ids, m = ids[order], m[order]
            some = min(len(ids), k + 1)  # the query's own row may be among them
            error = 4 * dim * np.finfo(float).eps * np.sqrt((m**2).sum(axis=1).max() * (q**2).sum(axis=1))
            for at in range(0, len(q), 256):
                near = q[at : at + 256] @ m.T
                cut = np.partition(near, len(ids) - some, axis=1)[:, len(ids) - some] - error[at : at + 256]
                # all that may tie with the last are kept, and all are scored one way in every block
                row, col = np.nonzero(near >= cut[:, None])
                exact = np.concatenate([(m[col[i : i + 65536]] * q[at + row[i : i + 65536]]).sum(axis=1) for i in range(0, len(row), 65536)])
                other = np.flatnonzero((ids[col] != q_ids[at + row]) & np.isfinite(exact))
                other = other[np.lexsort((col[other], -exact[other], row[other]))]
                start = np.searchsorted(row[other], np.arange(len(near) + 1))
                for i in range(len(near)):
                    best = other[start[i] : min(start[i + 1], start[i] + k)]
                    out["query_id"].append(q_ids[at + i])
                    out["far"].append(0.0 - exact[best])
                    out["ids"].append(ids[col[best]])
            out["part"] = [int(own["part"].iloc[0])] * len(out["query_id"])
        return pd.DataFrame(out)

    def merged(df: DataFrame, *keys: str) -> DataFrame:
        """The k best of the lists of a key: a few for each part, then one for each part probed."""
        return df.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))

    blocks_of = ["part", "rb", "qb"]
    found = left.groupBy(*blocks_of).cogroup(right.groupBy(*blocks_of)).applyInPandas(compare, "query_id long, part long, far array<double>, ids array<long>")
    best = merged(merged(found.select("query_id", "part", F.arrays_zip("far", "ids").alias("best")), "query_id", "part"), "query_id")
    each_best = best.select("query_id", F.posexplode("best").alias("rank", "b"))
    return each_best.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.ids").alias("vec_id"), (0.0 - F.col("b.far")).alias("score"))
