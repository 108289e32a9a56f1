"""A store, an encoder and a backend put together from settings: dated questions in, cited answers out."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schema
from quarry.operators import cite, expand
from quarry.plans import answer
from quarry.sources.store import Store

Encode = Callable[[str], Column]


@dataclass(frozen=True)
class Config:
    """store: its folder; model and dimension: those of the index; backend: the name of one that ``build`` is given."""

    store: str
    model: str
    dimension: int
    backend: str = "extractive"
    cache: bool = True
    retrieval: answer.Settings = answer.Settings()


@dataclass(frozen=True)
class Answered:
    passages: DataFrame
    answers: DataFrame
    citations: DataFrame


def checked(questions: DataFrame) -> DataFrame:
    """Questions (query_id, text, date) by the rules of a request: a text of 3 to 2000 characters and a date, else an error that names the question."""
    fault = F.when(~F.coalesce(F.length("text").between(3, 2000), F.lit(False)), "a question has 3 to 2000 characters").when(F.col("date").isNull(), "a reference date is needed")
    failed = F.raise_error(F.concat(fault, F.lit(": "), F.coalesce(F.col("query_id").cast("string"), F.lit("null"))))
    return questions.withColumn("text", F.when(fault.isNull(), F.col("text")).otherwise(failed))


def lines_of(passages: DataFrame) -> DataFrame:
    """(query_id, ref, id, start, end) of the lines of passages: each but the marks shows one provision, in the order of ``provisions``."""
    parts = passages.select("query_id", cite.ref(F.col("rank")).alias("ref"), "provisions", F.split("text", "\n").alias("_l"))
    start = F.aggregate(F.slice("_l", 1, F.col("_at")), F.lit(0), lambda total, x: total + F.length(x) + 1)
    nth = F.size(F.filter(F.slice("_l", 1, F.col("_at") + 1), lambda x: x != expand.MARK))
    rows = parts.select("*", F.posexplode("_l").alias("_at", "line")).where(F.col("line") != expand.MARK)
    return rows.select("query_id", "ref", F.get("provisions", nth - 1).alias("id"), start.alias("start"), (start + F.length("line")).alias("end"))


@dataclass(frozen=True)
class Service:
    store: Store
    encode: Encode
    backend: answer.Backend
    config: Config

    def chunks(self) -> DataFrame:
        """What the index holds, with the texts of the store."""
        held = self.store.read("chunk").select(F.xxhash64("chunk_id").alias("chunk_no"), "provision_id", F.col("vector").cast("array<double>").alias("vector"))
        texts = self.store.read("provision").select(F.col("id").alias("provision_id"), "norm_urn", "path", "type", "text", "valid_from", "revoked_on")
        return held.join(texts, "provision_id")

    def passages(self, questions: DataFrame) -> DataFrame:
        """Passages of questions (query_id, text, date, vector), each at its date, with where they are from."""
        chunks, nodes = self.chunks(), self.store.read("provision")
        found = answer.retrieve(questions, chunks.drop("vector"), chunks.select("chunk_no", "vector"), nodes, settings=self.config.retrieval)
        return answer.with_context(found, nodes, self.store.read("norm"))

    def ask(self, questions: DataFrame, folder: str, cache: DataFrame | None = None, calls: answer.Calls | None = None) -> Answered:
        """Answers to questions (query_id, text, date), with their passages and citations.

        Passages and answers are made once and written to ``folder``; answers can
        be the next call's ``cache``, which is not used if the settings say so.
        A question that breaks the rules of a request is an error.
        """
        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{folder}/{name}")
            return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

        asked = checked(questions.select("query_id", "text", "date"))
        asked = kept(asked.withColumn("vector", self.encode("text").cast("array<double>")), "questions")
        passages = kept(self.passages(asked), "passages")
        answers = kept(answer.answer(asked, passages, self.backend, cache=cache if self.config.cache else None, calls=calls), "answers")
        found = answer.cited(answers, passages, lines_of(passages))
        return Answered(passages, answers, answer.with_names(found, self.store.read("provision"), self.store.read("norm")))


def build(spark: SparkSession, config: Config, encode: Encode, backends: dict[str, answer.Backend] | None = None) -> Service:
    """The service that settings describe; an unknown backend, or an index that is missing or of another model, is an error at once."""
    known = {"extractive": answer.Extractive(), **(backends or {})}
    if config.backend not in known:
        raise ValueError(f"unknown backend {config.backend!r}; there are {sorted(known)}")
    store = Store(spark, config.store)
    if not store.exists("chunk-record"):
        raise schema.IncompatibleIndex(f"{config.store} has no index")
    found, wanted = json.loads(store.read("chunk-record").first()[0]), {"model": config.model, "dimension": config.dimension}
    if found != wanted:
        raise schema.IncompatibleIndex(f"index is {found}, wanted {wanted}")
    return Service(store, encode, known[config.backend], config)
