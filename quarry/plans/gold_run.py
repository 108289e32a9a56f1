"""Runs over an annotated set of questions: retrieval measured at each item's date, what answers would cost, answers measured."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import without_versions
from quarry.operators import evaluate
from quarry.plans import answer
from quarry.plans.answer import Backend


def questions(gold: DataFrame, encode: Callable[[str], Column]) -> DataFrame:
    """(query_id, item, mechanism, text, date, vector, expected, should_abstain); a query_id is the 64-bit hash of its item's id."""
    vector = encode("pergunta").cast("array<double>")
    expected = F.coalesce("dispositivos_esperados", F.array().cast("array<string>"))
    return gold.select(F.xxhash64("id").alias("query_id"), F.col("id").alias("item"), F.col("mecanismo").alias("mechanism"), F.col("pergunta").alias("text"), F.col("data_referencia").alias("date"), vector.alias("vector"), expected.alias("expected"), F.coalesce("deve_abster", F.lit(False)).alias("should_abstain"))


def measured(asked: DataFrame, passages: DataFrame, ks: tuple[int, ...] = evaluate.KS) -> DataFrame:
    """(item, mechanism, should_abstain, recall_k..., mrr, missing): one row for each item.

    A passage covers every provision that it shows, whatever its wording.  An
    item that expects nothing has found all of it; ``missing`` lists what no passage covers.
    """
    covered = passages.select("query_id", F.col("rank").alias("position"), F.explode("provisions").alias("id")).join(asked.select("query_id", "item"), "query_id")
    wanted = asked.select("item", F.explode(F.array_distinct(F.transform("expected", lambda e: without_versions(e)))).alias("expected"))
    found = evaluate.hits(wanted, covered.select("item", "position", without_versions(F.col("id")).alias("covered")))
    values = evaluate.with_nothing_expected(evaluate.recall_and_mrr(found, ks), asked, ks)
    missing = found.groupBy("item").agg(F.sort_array(F.collect_list(F.when(F.col("position").isNull(), F.col("expected")))).alias("missing"))
    rows = asked.select("item", "mechanism", "should_abstain").join(values, "item").join(missing, "item", "left")
    return rows.withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))


def report(items: DataFrame, ks: tuple[int, ...] = evaluate.KS) -> DataFrame:
    """(level, mechanism, items, recall_k..., mrr): means over all items and by mechanism; items that must be abstained from are in none."""
    return evaluate.report(items.where(~F.col("should_abstain")), "mechanism", [*[f"recall_{k}" for k in ks], "mrr"])


def retrieval(asked: DataFrame, chunks: DataFrame, vectors: DataFrame, nodes: DataFrame, settings: answer.Settings = answer.Settings(), ks: tuple[int, ...] = evaluate.KS, **more) -> DataFrame:
    """The measures of every item, each asked at its own date; as many passages are taken as the largest of ``ks``."""
    from dataclasses import replace

    deep = replace(settings, final_k=max(max(ks), settings.final_k))
    return measured(asked, answer.retrieve(asked.select("query_id", "text", "date", "vector"), chunks, vectors, nodes, settings=deep, **more), ks)


def estimate(sent: DataFrame, cache: DataFrame, backend: Backend, model: str, prices: DataFrame) -> DataFrame:
    """(questions, no_candidates, stored, payable, least_cost, most_cost) of requests before any is sent, in one row.

    Equal requests are paid once.  Costs reckon with the fewest and the most
    tokens that an answer may take; they are null for a model without a price,
    and 0 where nothing has to be paid.
    """
    known = answer.stored_by(cache, backend).select("request_sha", F.lit(True).alias("_stored"))
    each = sent.join(known, "request_sha", "left").withColumn("model", F.lit(model))
    pay = F.col("request_sha").isNotNull() & F.col("_stored").isNull()
    once = each.where(pay).dropDuplicates(["request_sha"])
    priced = evaluate.price(prices, once.select("model", "characters"))
    tokens, none = evaluate.estimated_tokens(F.col("characters")), F.lit(0)
    price = lambda out: evaluate.total_or_null(evaluate.cost(tokens, none, F.lit(out), F.col("input_price"), F.col("output_price")))
    costs = priced.agg(F.count(F.lit(1)).alias("payable"), price(evaluate.MIN_OUTPUT).alias("least_cost"), price(answer.MAX_TOKENS).alias("most_cost"))
    counts = each.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("request_sha").isNull()).alias("no_candidates"), F.count_if(F.col("_stored")).alias("stored"))
    zero = lambda c: F.when(F.col("payable") == 0, F.lit(0.0)).otherwise(F.round(c, 9)).alias(c)
    return counts.crossJoin(F.broadcast(costs)).select("questions", "no_candidates", "stored", "payable", zero("least_cost"), zero("most_cost"))


def needs_citations(backend: Backend) -> None:
    """An error for a backend that does not cite by itself: citations read out of its text would measure the reading."""
    if not backend.native_citations:
        raise ValueError(f"{backend.name} does not cite by itself: its citations cannot be measured")


def answers_measured(asked: DataFrame, answers: DataFrame, citations: DataFrame, backend: Backend) -> DataFrame:
    """(items, answered, failed, no_candidates, abstained, abstained_rightly, abstained_wrongly, accuracy, uncited) of answers, in one row.

    citations: query_id, id.  Accuracy is the mean over items that were
    answered and should be, uncited the share of these without any citation; a
    failed call is no abstention.  Accuracy needs a backend that cites by itself, for
    citations read out of a text would measure the reading.
    """
    needs_citations(backend)
    own = asked.join(answers.select("query_id", "abstention"), "query_id")
    cited = citations.join(asked.select("query_id", "item"), "query_id").select("item", F.col("id").alias("cited"))
    wanted = asked.select("item", F.explode("expected").alias("expected"))
    accuracy = evaluate.citation_accuracy(cited, wanted, asked).select("item", "accuracy", (F.col("cited") == 0).alias("bare"))
    every, should, why = F.lit(True), F.col("should_abstain"), F.coalesce("abstention", F.lit(""))
    did = ~why.isin("", "failed")
    counted = ~should & (why == "")
    measures = {
        "answered": (every, why == ""), "failed": (every, why == "failed"), "no_candidates": (every, why == "no candidates"), "abstained": (every, did),
        "abstained_rightly": (should, did), "abstained_wrongly": (~should, did), "accuracy": (counted, F.col("accuracy")), "uncited": (counted, F.col("bare")),
    }
    return evaluate.rates(own.join(accuracy, "item"), [], measures)


def end_to_end(asked: DataFrame, passages: DataFrame, lines: DataFrame, backend: Backend, model: str, prices: DataFrame, folder: str, cache: DataFrame | None = None, tolerant: bool = False) -> DataFrame:
    """One row: the measures of ``answers_measured``, then questions, no_candidate_questions, stored, sent, failed_calls, and cost of what was sent.

    Answers are made once and written to ``folder``, where they can serve as the
    next run's cache; calls are counted while they are made.  The cost is null
    if the model has no price, 0 if nothing was answered for pay.
    """
    needs_citations(backend)
    spark, calls = asked.sparkSession, answer.Calls()
    made = answer.answer(asked, passages, backend, cache=cache, calls=calls, tolerant=tolerant)
    made.write.parquet(folder)
    answers = spark.read.schema(made.schema).parquet(folder)
    measures = answers_measured(asked, answers, answer.cited(answers, passages, lines), backend)
    paid = answers.where("paid AND answer IS NOT NULL").dropDuplicates(["request_sha"]).withColumn("model", F.lit(model))
    priced = evaluate.price(prices, paid.select("model", "characters", F.length("answer").alias("said")))
    one = evaluate.cost(evaluate.estimated_tokens(F.col("characters")), F.lit(0), evaluate.estimated_output(F.col("said")), F.col("input_price"), F.col("output_price"))
    costs = priced.agg(F.when(F.count(F.lit(1)) == 0, F.lit(0.0)).otherwise(F.round(evaluate.total_or_null(one), 9)).alias("cost"))
    names = {"no_candidates": "no_candidate_questions", "failed": "failed_calls"}
    counts = [F.lit(n).cast("long").alias(names.get(name, name)) for name, n in calls.counts().items()]
    return measures.select("*", *counts).crossJoin(F.broadcast(costs))
