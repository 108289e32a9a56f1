"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; ``run`` writes every stage's rows as Parquet in the shared folder and
reads them again.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import mixing, packing, simhash, suffix_dedup, toxicity
from quarry.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold of their language; the model learns from all labelled rows.

    Null and empty texts have a score too, that of no words, and stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=F.lit(True))
    return toxicity.classify(docs, model).where(~F.col("toxic_flag")).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (that of the smallest id) of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.distinct_documents(docs, words=5, similarity=0.8).select(*COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier in the corpus; whole characters stay whole.

    A document of which nothing but blanks is left goes; one that loses nothing
    stays as it is, null and empty texts too.
    """
    cut = suffix_dedup.dedup(docs, length=100, whole_characters=True)
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.decode("kept", "UTF-8"))
    shorter = cut.withColumn("text", text).where((F.size("removed") == 0) | (F.length(F.trim("text")) > 0))
    return shorter.withColumn("n_chars", F.when(F.size("removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to twice; those not taken go, those without words among them.

    Rows equal in id and text share what the mix takes of them, the earlier
    ones one more than the others.
    """
    keys = {"_none": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)), "_text": F.xxhash64("text")}
    sized = docs.withColumns(keys).select(*keys, "doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    mix = mixing.mix(written(sized, "sizes"), F.col("words"), weights=(5, 2, 1), share=1.5, most=2.0)
    taken = mix.groupBy(*keys).agg(F.sum("times").alias("_times"), F.count(F.lit(1)).alias("_rows")).where("_times > 0")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*COLUMNS))
    times = F.floor(F.col("_times") / F.col("_rows")).cast("int") + (nth <= F.col("_times") % F.col("_rows")).cast("int")
    rows = docs.select(*COLUMNS).withColumns(keys).join(taken, list(keys)).withColumn("_times", times).where("_times > 0")
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "_times"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("simhash near-dedup", without_near_copies),
    ("suffix-array dedup", without_repeated_passages),
    ("source mixing", mixed),
    ("packing", packed),
]

#: None: a trained classifier and fingerprints are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
