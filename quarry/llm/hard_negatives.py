"""Hard negatives by a secondary-sort shuffle.

Every anchor is compared with all rows, block by block, in two products.  The
first leaves each anchor's best rows of its own label, of which the best of all
blocks are its positives.  The second leaves, of a block, the rows of other
labels that come first below one of these positives: no other row of the block
can be among those returned.  What is left is packed into keys of (anchor,
descending score, id), and ``repartitionAndSortWithinPartitions`` brings an
anchor's pairs into one partition in that order.  There an iterator walks over
them: a positive opens a window of scores, the negatives that follow fall into
the windows that are open, and a window closes when it is full or passed.  It
keeps the open windows and the last few negatives of one score, never an anchor.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import written

BLOCK_ROWS, BLOCK_ANCHORS = 4096, 1024
#: 8 bytes for the anchor, 8 for the score (the highest first), 8 for the id, 1 for whether the labels are the same.
KEY = ">QQQB"
HALF, ALL = 1 << 63, (1 << 64) - 1


def packed_key(anchor: int, score: int, row: int, same: bool) -> bytes:
    """Bytes whose order is that of (anchor, descending score, id); signed 64-bit numbers."""
    return struct.pack(KEY, anchor + HALF, ALL - (score + HALF), row + HALF, same)


def unpacked_key(key: bytes) -> tuple[int, int, int, bool]:
    anchor, score, row, same = struct.unpack(KEY, key)
    return anchor - HALF, ALL - score - HALF, row - HALF, bool(same)


def home(key: bytes) -> int:
    """Where the pairs of an anchor go: a number that spreads ids of any spacing over all partitions."""
    return struct.unpack_from(">Q", key)[0] * 0x9E3779B97F4A7C15 >> 29 & 0x7FFFFFFF


def walk(pairs: Iterator[tuple[int, int, int, bool]], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(anchor, positive, rank, negative, positive score, negative score) from pairs in the order of their keys.

    A negative belongs to a positive of score p if low * p <= 100 * its score <=
    high * p; ``high`` is 100 at most, so only negatives of the positive's own
    score can precede it.
    """
    anchor, opened, windows, at, level = None, 0, [], None, []
    for a, score, row, same in pairs:
        if a != anchor:
            anchor, opened, windows, at = a, 0, [], None
        if score != at:
            at, level = score, []
            windows = [w for w in windows if low * w[1] <= 100 * score and w[2] < negatives]
        if same and opened < positives:
            opened += 1
            window = [row, score, 0]
            windows.append(window)
            found = [(window, n) for n in level]
        elif same:
            continue
        else:
            found = [(w, row) for w in windows]
            if len(level) < negatives:
                level.append(row)
        for w, n in found:
            if w[2] < negatives and low * w[1] <= 100 * score <= high * w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], n, w[1], score


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products of two blocks of 64-bit integers; beyond 64 bits they are cut to the nearest."""
    most = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    if most(anchors) * most(rows) * max(1, anchors.shape[1]) < 1 << 53:
        return np.rint(anchors.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    exact = anchors.astype(object) @ rows.T.astype(object)
    return np.clip(exact, -HALF, HALF - 1).astype(np.int64)


def prepared(rows: DataFrame, label: Column, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """(id, label, v): rows that take part, with integer components; one for each id, of the most frequent dimension."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    typed = rows.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(vector_column, lambda x: x.cast("double")).alias("v"))
    valid = typed.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
    whole = valid.select("id", "label", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v"))
    single = whole.groupBy("id").agg(F.min(F.struct("label", "v")).alias("_r")).select("id", "_r.label", "_r.v")
    sizes = single.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return single.where(F.size("v") == (sizes["dim"] if sizes else 0))


def mine(rows: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score is its integer inner product with the anchor, components
    being floor(scale * x).  An anchor's positives are its first ``positives``
    other rows of the same label, the highest scores first, ties by the smaller
    id; for each, the first ``negatives`` rows of another label with
    low * positive_score <= 100 * score <= high * positive_score are returned,
    fewer if there are fewer.  ``is_anchor`` is a condition on ``id``.

    Rows with a null id, label or vector, or a null or non-finite component,
    take no part, nor do vectors of another dimension than the most frequent
    one.  Rows of one id count once, with the least label and then vector.
    Components and scores beyond 64 bits are cut to the nearest.  Extra columns
    are not read; an empty table gives an empty result.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("windows lie below their positive: 0 <= low <= high <= 100")
    spark = rows.sparkSession
    own = written(prepared(rows, F.col(label) if isinstance(label, str) else label, scale, id_column, vector_column), "mine-rows")
    asked = own.where(is_anchor)
    row_blocks, anchor_blocks = max(1, -(-own.count() // BLOCK_ROWS)), max(1, -(-asked.count() // BLOCK_ANCHORS))
    spread = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys, blocks = ["rb", "ab"], row_blocks * anchor_blocks
    left = own.select(spread(row_blocks).alias("rb"), each(anchor_blocks).alias("ab"), "id", "label", "v")
    in_blocks = lambda df, *more: df.select(each(row_blocks).alias("rb"), spread(anchor_blocks).alias("ab"), *[F.col(c).alias(c) for c in ("id", "label", "v", *more)])
    tasks = max(blocks, 1) if blocks < 1000 else 1000 + blocks // 8

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, *keys).groupBy(*keys)

    def compared(block: pd.DataFrame, ask: pd.DataFrame) -> Iterator[tuple]:
        """(anchor's place, its scores, ids and labels of the block), by ascending id."""
        block = block.sort_values("id", kind="stable")
        ids, labels = block["id"].to_numpy(), block["label"].to_numpy()
        if len(block) and len(ask):
            m = np.stack(block["v"].to_numpy())
            for at in range(0, len(ask), 128):
                part = ask.iloc[at : at + 128]
                for i, scores in enumerate(products(np.stack(part["v"].to_numpy()), m)):
                    yield at + i, scores, ids, labels

    def first(scores: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
        """The k of ``places`` (ascending ids) of the highest scores, ties by place."""
        if len(places) > k:
            cut = np.partition(scores[places], len(places) - k)[len(places) - k]
            places = places[scores[places] >= cut]
        return places[np.argsort(-scores[places].astype(np.float64) if abs(scores[places]).max(initial=0) < 1 << 53 else np.array([-int(s) for s in scores[places]], object), kind="stable")[:k]]

    def best_same(block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        anchors, anchor_labels = ask["id"].to_numpy(), ask["label"].to_numpy()
        for i, scores, ids, labels in compared(block, ask):
            same = np.flatnonzero((labels == anchor_labels[i]) & (ids != anchors[i]))
            out += [(anchors[i], scores[j], ids[j]) for j in first(scores, same, positives)]
        return pd.DataFrame(out, columns=["anchor", "score", "row"])

    local = dealt(left).cogroup(dealt(in_blocks(asked))).applyInPandas(best_same, "anchor long, score long, row long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "row")
    found = local.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= positives)
    chosen = written(found.select("anchor", "score", "row"), "mine-positives")
    opened = chosen.groupBy(F.col("anchor").alias("id")).agg(F.collect_set("score").alias("p"))

    def below(block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        anchors, anchor_labels, opens = ask["id"].to_numpy(), ask["label"].to_numpy(), ask["p"].to_numpy() if len(ask) else []
        for i, scores, ids, labels in compared(block, ask):
            keep: set[int] = set()
            spans = [(-(-low * int(p) // 100), high * int(p) // 100) for p in opens[i]]
            outside = labels != anchor_labels[i]
            outside &= (scores >= min(s for s, _ in spans)) & (scores <= max(s for _, s in spans))
            others = np.flatnonzero(outside)
            for least, most in spans:
                keep.update(first(scores, others[(scores[others] >= least) & (scores[others] <= most)], negatives))
            out += [(anchors[i], scores[j], ids[j]) for j in sorted(keep)]
        return pd.DataFrame(out, columns=["anchor", "score", "row"])

    others = dealt(left).cogroup(dealt(in_blocks(asked.join(opened, "id"), "p"))).applyInPandas(below, "anchor long, score long, row long")
    pairs = chosen.withColumn("same", F.lit(True)).unionByName(others.withColumn("same", F.lit(False)))
    keyed = pairs.rdd.map(lambda r: (packed_key(r["anchor"], r["score"], r["row"], r["same"]), None))
    parts = max(keyed.ctx.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = keyed.repartitionAndSortWithinPartitions(parts, home)
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    out = ordered.mapPartitions(lambda part: (Row(*x) for x in walk((unpacked_key(k) for k, _ in part), positives, negatives, low, high)))
    return spark.createDataFrame(out, ", ".join(f"{n} {'int' if n == 'rank' else 'long'}" for n in names), verifySchema=False)
