"""Ranked lexical search: an exact inner-product search on ball trees of sparse document vectors.

A document's score is the sum, over the terms of an item that it holds, of the
term's weight times an integer that grows with the term's frequency.  That is
the inner product of the document's sparse vector with the set of the item's
terms.  Each task builds ball trees over documents of its own, a bounded number
to a tree, and searches every tree for every item of a group, best node first;
what it has found so far prunes the next trees.  Only coordinates that some
item asks for are kept.  Then the best of all tasks are ranked together.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ball_tree import BallTree, Best, Rows
from .common import SLICE_ROWS, text_bytes, written

#: Distinct terms of the items that are searched for together; documents and coordinates of a tree; lists of one item that meet in a task.
GROUP_TERMS, TREE_ROWS, TREE_CELLS, MERGED = 200_000, 8192, 1 << 19, 256
#: A to Z in lower case, other bytes that are no part of a term as blanks.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TERMS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


def asked_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, term): the distinct terms of each item."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return items.select(F.col(item_id).cast("long").alias("item"), F.explode(F.regexp_extract_all(lower, F.lit(TERMS), F.lit(0))).alias("term")).distinct()


def counted(docs: DataFrame, terms: list[str], id_column: str, text: str) -> DataFrame:
    """(id, n, terms, tf): of each document with a term its length, and the terms (their places in ``terms``) and frequencies that are asked for."""
    known = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})  # GROUP_TERMS, or one item's terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = known.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                lengths, held, times = [], [], []
                for body in text_bytes(part["text"]):
                    found = terms_of(body)
                    own = Counter(filter(places.__contains__, found))
                    order = sorted((places[t], c) for t, c in own.items())
                    lengths.append(len(found))
                    held.append([p for p, _ in order])
                    times.append([c for _, c in order])
                yield pa.record_batch({"id": part["id"], "n": pa.array(lengths, pa.int64()), "terms": pa.array(held, pa.list_(pa.int32())), "tf": pa.array(times, pa.list_(pa.int32()))})
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, n long, terms array<int>, tf array<int>").where("n > 0")


def weights(frequency: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in frequency], np.int64)


def saturated(tf: np.ndarray, n: np.ndarray, size: np.ndarray, documents: int, length: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 20 * m) with m = 50 + (50 * n * documents) div length, for the ``size`` terms of each document."""
    m = np.array([50 + 50 * int(x) * documents // length for x in n], np.int64)  # of Python's integers, which do not overflow
    m = np.repeat(m, size)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score above 0 for each item, ties by ascending id.

    Whole texts are read.  A null or empty text has no terms: such a document
    counts nowhere, such an item finds nothing.  An item is an id, null too;
    the terms of its rows are united.  Each row of ``docs`` is a document, so
    rows of one id are ranked each; a document without id counts, and comes
    after all others of its score.  Extra columns are not read; empty tables
    give an empty result.  Items are searched for in groups of a bounded number
    of terms, each in one pass over the documents.
    """
    asked = written(asked_terms(items, item_id, text), "search-terms")
    groups = max(1, -(-asked.count() // GROUP_TERMS))
    found = [_search(docs, asked.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g), k, id_column, text) for g in range(groups)]
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    in_part = Window.partitionBy("item", "part").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    overall = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    merged = best.withColumn("part", F.pmod("task", F.lit(MERGED))).withColumn("_n", F.row_number().over(in_part)).where(F.col("_n") <= k)
    ranked = merged.withColumn("rank", F.row_number().over(overall)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def _search(docs: DataFrame, asked: DataFrame, k: int, id_column: str, text: str) -> DataFrame:
    """(item, task, id, score): the k best of each task for each of a group of items."""
    rows = asked.groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms")).orderBy("item").collect()
    terms = sorted({t for r in rows for t in r["terms"]})
    place = {t: i for i, t in enumerate(terms)}
    items = [(r["item"], np.array([place[t] for t in r["terms"]], np.int64)) for r in rows]
    vectors = written(counted(docs, terms, id_column, text), "search-vectors")
    total = vectors.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    documents, length = total["documents"], total["length"] or 1
    frequency = np.zeros(len(terms), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a number for each term that is asked for
        frequency[r["t"]] = r["count"]
    shared = docs.sparkSession.sparkContext.broadcast((items, weights(frequency, documents)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_items, weight = shared.value
        best = [Best(k) for _ in asked_items]
        for ids, tree in _trees(batches, weight, documents, length):
            for (_, query), own in zip(asked_items, best, strict=True):
                tree.search(query, ids, own)
        for (item, _), own in zip(asked_items, best, strict=True):
            if len(own.ids):
                none = own.ids == np.iinfo(np.int64).max
                yield pa.record_batch({"item": pa.array([item] * len(own.ids), pa.int64()), "id": pa.array(own.ids, mask=none), "score": pa.array(own.scores)})

    rows_in = vectors.where(F.size("terms") > 0)
    return rows_in.mapInArrow(run, "item long, id long, score long").withColumn("task", F.spark_partition_id())


def _trees(batches: Iterator[pa.RecordBatch], weight: np.ndarray, documents: int, length: int) -> Iterator[tuple[np.ndarray, BallTree]]:
    """Ball trees over the rows of a task, each of a bounded number of documents and of coordinates (or of one document)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    n_rows = n_cells = 0

    def built() -> tuple[np.ndarray, BallTree]:
        ids, size, cols, vals = (np.concatenate(x) for x in zip(*held, strict=True))
        return ids, BallTree(Rows(np.concatenate(([0], np.cumsum(size))), cols, vals), weight)

    for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
        ids = batch["id"].fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        cols, tf = (batch[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tf"))
        size = batch["terms"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        n = batch["n"].to_numpy(zero_copy_only=False)
        vals = saturated(tf, n, size, documents, length)
        if n_rows and (n_rows + len(ids) > TREE_ROWS or n_cells + len(cols) > TREE_CELLS):
            yield built()
            held, n_rows, n_cells = [], 0, 0
        held.append((ids, size, cols, vals))
        n_rows, n_cells = n_rows + len(ids), n_cells + len(cols)
    if held:
        yield built()
