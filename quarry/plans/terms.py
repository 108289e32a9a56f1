"""The stored inverted index: postings by a hash of their term, replaced norm by norm.

A posting lies in the bucket of its term, a folder of each segment, so a search
reads the buckets of the terms that are asked for and no other file.  Weights
need how many documents there are: each norm's number of documents is stored
beside its postings, by the same commit.
"""

from __future__ import annotations

import json
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import schema
from quarry.operators import search
from quarry.operators.search import PORTUGUESE, Analysis
from quarry.sources.store import Commit, Store, Tables

#: Folders that terms are dealt to; the number is recorded when an index is made.
BUCKETS = 64
#: Documents whose postings one task writes, at least where there are enough for all cores, and at most.
FEW, MANY = 1_000, 20_000


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def record(tables: Tables) -> dict:
    """Bucket count and analysis of the index; empty if none was made."""
    return json.loads(tables.read("posting-record").first()[0]) if tables.exists("posting-record") else {}


def build(store: Store | Commit, docs: DataFrame, norms: DataFrame | None = None, analysis: Analysis = PORTUGUESE, buckets: int = BUCKETS) -> None:
    """Indexes docs (norm_urn, id, text); their norms, and those of ``norms`` (norm_urn), lose all they had before.

    Null and empty texts have no postings but count as documents; an id is long
    and names one document.  Another analysis than the recorded one is an error.
    """
    if isinstance(store, Store):
        with store.commit() as changes:
            return build(changes, docs, norms, analysis, buckets)
    if not (known := record(store)):
        known = {"buckets": buckets, "analysis": analysis.name}
        store.rewrite("posting-record", store.spark.createDataFrame([(json.dumps(known),)], "value string"))
    if known["analysis"] != analysis.name:
        raise schema.IncompatibleIndex(f"index has other words: {known['analysis']}")
    posts = search.postings(docs, "text", "id", analysis, more=("norm_urn",)).withColumn("bucket", bucket(F.col("term"), known["buckets"]))
    replaced = docs.select("norm_urn") if norms is None else docs.select("norm_urn").unionByName(norms.select("norm_urn"))
    # every task writes a file of each bucket it has terms of: postings are not shuffled, and few texts are few tasks
    n = docs.count()
    tasks = max(1, -(-n // MANY), min(docs.sparkSession.sparkContext.defaultParallelism, n // FEW))
    store.replace("posting", posts.select(*[F.col(f.name).cast(f.dataType) for f in schema.POSTING]).coalesce(tasks), replaced.distinct())
    counts = docs.groupBy("norm_urn").agg(F.count(F.lit(1)).alias("documents")).select("documents", "norm_urn")
    store.replace("indexed", counts, replaced.distinct())


def documents(tables: Tables) -> int:
    return tables.read("indexed").agg(F.sum("documents")).first()[0] or 0


def postings(tables: Tables, asked: DataFrame) -> DataFrame:
    """(id, term, tf, length) of the terms of ``asked``; only their buckets are read.

    At most as many numbers as there are buckets come to the driver.
    """
    if not (known := record(tables)):
        return tables.spark.createDataFrame([], "id long, term string, tf long, length long")
    terms = asked.select("term").distinct()
    held = sorted(r[0] for r in terms.select(bucket(F.col("term"), known["buckets"]).alias("b")).distinct().collect())
    rows = tables.read("posting").where(F.col("bucket").isin(held) if held else F.lit(False))
    return rows.join(search.sent(terms), "term", "left_semi").select("id", "term", "tf", "length")


def bm25(tables: Tables, queries: DataFrame, k: int = search.LEG, analysis: Analysis = PORTUGUESE, allowed: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k best documents of the index for each of ``queries`` (query_id, text)."""
    posts = postings(tables, search.asked_terms(queries, analysis))
    return search.bm25(queries, posts, documents(tables), k, allowed=allowed, analysis=analysis)
