"""Connected components of a link table, by alternating stars on DataFrames.

Each round replaces the links by stars around smallest neighbours (large star,
then small star); the number of rounds grows with the logarithm of the longest
chain.  Links stay in Spark tables throughout; the driver sees one number a
round.  Hubs are handled by partial aggregation and joins that AQE may split.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _forest(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The links of a batch, thinned to a spanning forest with the same components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    found = [(x, r) for x in parent if (r := root(x)) != x]
    return pa.record_batch({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([r for _, r in found], pa.int64())})


def thinned(links: DataFrame) -> DataFrame:
    """Links (u, v) with those left out that close a cycle within some thousand of them."""
    return links.select("u", "v").mapInArrow(lambda batches: map(_forest, batches), "u long, v long")


def settled(links: DataFrame) -> bool:
    """Whether links (u, v; distinct, u > v) are stars: every u has one v, which is no u itself.

    A round leaves stars as they are, so none has to run to see that it changes nothing.
    """
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    faults = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 OR (ups = 1 AND least = 0)")
    return faults.agg(F.count(F.lit(1))).first()[0] == 0


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node of ``links`` (u long, v long), root its component's smallest node.

    Null ends are dropped, loops and repeated links have no effect, an empty
    table gives an empty result.
    """
    sides = written(links.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL"), "links")  # links are worked out once
    stars = written(thinned(sides.where("u <> v")).distinct(), "stars")
    for _ in range(max_rounds):
        if settled(stars):
            break
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        centre = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(centre, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, stars = stars, written(small.where("u <> v").distinct(), "stars")
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    rooted = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    loops = sides.where("u = v").select(F.col("u").alias("node")).distinct()
    alone = loops.join(rooted.union(roots), "node", "left_anti").select("node", F.col("node").alias("root"))
    return rooted.union(roots).union(alone)
