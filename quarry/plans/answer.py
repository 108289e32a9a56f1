"""Questions to answers: retrieval, request, cache, backend, citations, for a whole table of questions."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarry.functions.text import day_number, day_or_far
from quarry.operators import cite, expand, lookup, naming, search
from quarry.operators.temporal import in_force, search_filter
from quarry.plans import terms
from quarry.schema import BackendFailed
from quarry.sources.store import Tables

#: Limits of a request, and what is said without any candidate.
MAX_TOKENS, PROMPT_VERSION = 8192, "v1"
NO_CANDIDATES = "Não encontrei nenhum dispositivo no corpus que trate do que foi perguntado, na data de referência da consulta."


@dataclass(frozen=True)
class Settings:
    search_k: int = search.FUSED
    leg_k: int = search.LEG
    final_k: int = search.FINAL
    rerank: bool = False
    level: str = "article"
    max_chars: int = expand.MAX_CHARS


def check_question(question: str, date: str | None, top_k: int = search.FINAL) -> None:
    """The rules of a request; ValueError says which is broken."""
    if not 3 <= len(question) <= 2000:
        raise ValueError("a question has 3 to 2000 characters")
    if not date:
        raise ValueError("a reference date is needed")
    if not 1 <= top_k <= 20:
        raise ValueError("top_k is 1 to 20")


class Backend(Protocol):
    name: str
    native_citations: bool

    def generate(self, system: str, documents: list[dict], question: str) -> tuple[str, list[dict]]:
        """Answer and quotations: ref, quoted, from, to."""


class Extractive:
    """An offline backend: quotes the line of each passage that shares most words with the question."""

    name, native_citations = "extractive", True

    def generate(self, system: str, documents: list[dict], question: str) -> tuple[str, list[dict]]:
        words_of = lambda text: set(re.findall(r"\w+", text.lower()))
        words = words_of(question)
        quotes, shown = [], []
        for d in documents:
            at, best = 0, (0, 0, "")
            for line in d["text"].split("\n"):
                shared = len(words & words_of(line))
                if shared > best[0] and line != expand.MARK:
                    best = (shared, at, line)
                at += len(line) + 1
            if best[0]:
                quotes.append({"ref": d["ref"], "quoted": best[2], "from": best[1], "to": best[1] + len(best[2])})
                shown.append(f"{best[2]} [{d['ref']}]")
        return ("\n".join(shown) or cite.ABSTAINS), quotes


def request_key(system: str, documents: list[dict], question: str, max_tokens: int = MAX_TOKENS) -> str:
    """Content address of a request; the model has no part in it."""
    body = {"system": system, "question": question, "max_tokens": max_tokens, "documents": documents}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def system_prompt(date: str, native: bool) -> str:
    rules = [f"Responda apenas com base nos trechos fornecidos, na redação vigente em {date}.", f"Se eles não bastarem, comece a resposta com: {cite.ABSTAINS}"]
    return "\n".join(rules if native else [*rules, "Depois de cada afirmação, indique o trecho como [D1]."])


def rendered(documents: list[dict], question: str) -> str:
    """A request as one text, for backends that take no documents: each passage with where it is from, then the question."""
    shown = [f'<passage ref="{d["ref"]}" title="{d["title"]}" {d["context"]}>\n{d["text"]}\n</passage>' for d in documents]
    return "\n\n".join([*shown, question])


def with_context(passages: DataFrame, nodes: DataFrame, norms: DataFrame) -> DataFrame:
    """Adds provision_id, full_label and source_url: which provision a passage is, what it is called and where it is published."""
    place = ["norm_urn", "target_path"]
    ids = nodes.select("norm_urn", F.col("path").alias("target_path"), F.col("id").alias("provision_id"))
    labels = naming.full_labels(nodes).withColumnRenamed("path", "target_path")
    return naming.with_source_url(passages.join(ids, place, "left").join(labels, place, "left"), norms)


def cache_use(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(requests, stored, sent): of the requests that need an answer, how many have one and how many different ones are sent."""
    asked = requests.where("request_sha IS NOT NULL").join(cache.select("request_sha", F.lit(True).alias("_s")).distinct(), "request_sha", "left")
    return asked.agg(F.count(F.lit(1)).alias("requests"), F.count("_s").alias("stored"), F.count_distinct(F.when(F.col("_s").isNull(), F.col("request_sha"))).alias("sent"))


def retrieve(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, nodes: DataFrame, date: Column | None = None, settings: Settings = Settings(), norms: list[str] | None = None, types: list[str] | None = None, index: Tables | None = None, analysis: search.Analysis = search.PORTUGUESE) -> DataFrame:
    """Passages of questions (query_id, text, vector) at one reference date, or each at its own (a column date).

    chunks: chunk_no, provision_id, norm_urn, path, type, text, valid_from, revoked_on; vectors: chunk_no, vector.
    The filter on time, norms and types comes before each leg is cut.  ``index``
    has the stored postings of the chunks (``terms.build``, by chunk_no), of which
    only those of the questions' terms are read; without it they are made from
    the chunks.
    """
    asked_at = questions if date is None else questions.withColumn("date", date)
    live = chunks.where(search_filter(date, norms, types))
    asked = search.asked_terms(asked_at, analysis, "date")
    posts = search.postings(chunks, "text", "chunk_no", analysis, terms=asked) if index is None else terms.postings(index, asked)
    window = live.select(F.col("chunk_no").alias("id"), "valid_from", "revoked_on")
    # weights count all chunks, ranks those alone that were in force on the question's day
    hits = search.weighed(posts, chunks.count() if index is None else terms.documents(index), asked).join(window, "id").join(search.sent(asked), "term").where(in_force(F.col("date")))
    scored = hits.groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score"))
    sparse = search.top_k(scored, ["query_id"], [F.desc("score"), F.asc("id")], settings.leg_k)
    first = F.coalesce(day_number(F.col("valid_from")), F.lit(0)).alias("from_day")
    held = vectors.join(live.select("chunk_no", first, day_or_far(F.col("revoked_on")).alias("to_day")), "chunk_no").select(F.col("chunk_no").alias("id"), "vector", "from_day", "to_day")
    dense = search.cosine(asked_at.select("query_id", "vector", day_number(F.col("date")).alias("day")), held, settings.leg_k)
    fused = search.fuse([dense, sparse], settings.search_k)
    hydrated = fused.join(chunks.select(F.col("chunk_no").alias("id"), "norm_urn", "path", F.col("text").alias("passage")), "id")
    ask = asked_at.select("query_id", "date", F.col("text").alias("question"))
    score = F.lit(None)
    if settings.rerank:  # a reranker reads where a passage is from, too
        hydrated = hydrated.join(naming.full_labels(nodes), ["norm_urn", "path"], "left")
        score = search.overlap_score(F.col("question"), search.rerank_text(F.col("full_label"), F.col("passage")))
    ranked = search.rerank(hydrated.join(ask, "query_id"), score, settings.final_k * 2)
    out = expand.expand(ranked.select("query_id", "date", "norm_urn", "path", "rank", "score", "rerank_score"), nodes, F.col("date"), settings.level, settings.max_chars)
    return out.where(F.col("rank") <= settings.final_k)


def unanswered(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests, each once, whose answer is not stored."""
    return lookup.without(requests.where("request_sha IS NOT NULL").dropDuplicates(["request_sha"]), cache, "request_sha")


def cited(answers: DataFrame, passages: DataFrame, lines: DataFrame) -> DataFrame:
    """(query_id, span_id, id, quoted): the provisions that the quotations of answers come from.

    passages: query_id, rank, text; lines: query_id, ref, id, start, end.
    """
    quotes = answers.select("query_id", F.posexplode("quotes").alias("span_id", "q")).select("query_id", "span_id", "q.ref", "q.quoted", "q.from", "q.to")
    known = passages.select("query_id", cite.ref(F.col("rank")).alias("ref"), "text")
    return cite.resolve(quotes, known, lines)


def with_names(citations: DataFrame, nodes: DataFrame, norms: DataFrame) -> DataFrame:
    """Citations (id, ...) with full_label and source_url of the provision that is cited, which may lie inside the passage; null for an unknown id."""
    places = nodes.select(F.col("id"), "norm_urn", "path").join(naming.full_labels(nodes), ["norm_urn", "path"])
    named = naming.with_source_url(places.select("id", "norm_urn", "full_label"), norms).select("id", "full_label", "source_url")
    return citations.join(named, "id", "left")


DOCUMENT = "struct<ref: string, title: string, context: string, text: string>"


def requests(questions: DataFrame, passages: DataFrame, backend: Backend, date: str | None = None) -> DataFrame:
    """(query_id, question, system, documents, request_sha, characters): what would be sent for each question, at its own date (a column) or at one.

    A question without passages has no request_sha: nothing is sent for it.
    """
    title, context = F.lit(""), F.lit("")
    if {"provision_id", "full_label", "source_url"} <= set(passages.columns):
        title, context = F.coalesce("full_label", F.lit("")), F.concat(F.lit("fonte: "), F.coalesce("source_url", F.lit("")), F.lit(" | id: "), F.coalesce("provision_id", F.lit("")))
    docs = F.sort_array(F.collect_list(F.struct("rank", cite.ref(F.col("rank")).alias("ref"), title.alias("title"), context.alias("context"), "text")))
    day = (F.col("date") if date is None else F.lit(date)).cast("string").alias("day")
    asked = questions.select("query_id", F.col("text").alias("question"), day).join(passages.groupBy("query_id").agg(docs.alias("documents")), "query_id", "left")
    native = backend.native_citations

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = [[{k: d[k] for k in ("ref", "title", "context", "text")} for d in ds] if ds is not None else [] for ds in batch["documents"]]
            systems = [system_prompt(day, native) for day in batch["day"]]
            shas = [request_key(y, b, q) if b else None for y, b, q in zip(systems, bodies, batch["question"], strict=True)]
            sizes = [len(y) + len(q) + sum(len(v) for d in b for v in d.values()) for y, b, q in zip(systems, bodies, batch["question"], strict=True)]
            yield pd.DataFrame({"query_id": batch["query_id"], "question": batch["question"], "system": systems, "documents": bodies, "request_sha": shas, "characters": sizes})

    return asked.mapInPandas(keyed, f"query_id long, question string, system string, documents array<{DOCUMENT}>, request_sha string, characters long")


def stored_by(cache: DataFrame, backend: Backend) -> DataFrame:
    """What a cache (request_sha, backend, answer, quotes) has of one backend: answers of another are not its own."""
    return cache.where(F.col("backend") == backend.name).select("request_sha", "answer", "quotes").dropDuplicates(["request_sha"])


@dataclass
class Calls:
    """Counters of one run of ``answer``, taken while its rows pass: no second scan.

    They are there once an action on the answers has ended; use one for one run.
    A task that runs again after its executor was lost may count its rows again.
    """

    asked: Observation = field(default_factory=Observation)
    made: Observation = field(default_factory=Observation)

    def counts(self) -> dict[str, int]:
        """questions; no_candidates and stored among them; different requests that were sent; failed among these."""
        asked, made = self.asked.get, self.made.get
        return {n: int(found.get(n) or 0) for found, names in ((asked, ("questions", "no_candidates", "stored")), (made, ("sent", "failed"))) for n in names}


def answer(questions: DataFrame, passages: DataFrame, backend: Backend, date: str | None = None, cache: DataFrame | None = None, calls: Calls | None = None, tolerant: bool = False) -> DataFrame:
    """(query_id, request_sha, backend, answer, abstention, quotes, characters, paid): one row for each question, answered at its own date or at one for all.

    Passages with the columns of ``with_context`` tell the backend their title
    and source.  A question without passages is answered without the backend; requests in
    ``cache`` (request_sha, backend, answer, quotes) that this backend answered are not sent again.
    paid says whether a question's request was sent (true), stored (false) or
    neither (null).  A backend that fails ends the run; if ``tolerant``, its
    question has a null answer and the abstention "failed".
    """
    kind = "request_sha string, answer string, quotes array<struct<ref: string, quoted: string, from: long, to: long>>"

    def asked_of(system: str, documents: list[dict], question: str) -> tuple[str | None, list[dict]]:
        try:
            return backend.generate(system, documents, question)
        except BackendFailed:
            if not tolerant:
                raise
            return None, []

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [asked_of(y, list(d), q) for y, d, q in zip(batch["system"], batch["documents"], batch["question"], strict=True)]
            yield pd.DataFrame({"request_sha": batch["request_sha"], "answer": [a for a, _ in made], "quotes": [q for _, q in made]})

    asked = requests(questions, passages, backend, date)
    stored = stored_by(cache, backend) if cache is not None else None
    payable = asked.where("request_sha IS NOT NULL").dropDuplicates(["request_sha"]) if stored is None else unanswered(asked, stored)
    made = payable.mapInPandas(sent, kind)
    if calls:
        made = made.observe(calls.made, F.count(F.lit(1)).alias("sent"), F.count_if(F.col("answer").isNull()).alias("failed"))
    made = made.withColumn("paid", F.lit(True))
    known = made if stored is None else made.unionByName(stored.withColumn("paid", F.lit(False)))
    both = asked.join(known, "request_sha", "left")
    none = F.col("request_sha").isNull()
    text = F.when(none, F.lit(NO_CANDIDATES)).otherwise(F.col("answer"))
    why = F.when(none, "no candidates").when(F.col("answer").isNull(), "failed").when(cite.abstains(text), "insufficient context")
    if calls:
        both = both.observe(calls.asked, F.count(F.lit(1)).alias("questions"), F.count_if(none).alias("no_candidates"), F.count_if(~F.col("paid")).alias("stored"))
    return both.select("query_id", "request_sha", F.lit(backend.name).alias("backend"), text.alias("answer"), why.alias("abstention"), "quotes", "characters", "paid")
