"""Citations: resolving quotations to provisions, anchors in answers, abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.expand import overlap

#: Fixed value: how an answer starts that finds no support.
ABSTAINS = "SEM FUNDAMENTO NOS TRECHOS"


def matches(text: Column, quoted: Column, start: Column, end: Column) -> Column:
    """Whether the slice [start, end) of a text, in code points, is the quotation."""
    return F.substring(text, start + 1, end - start) == quoted


def resolve(quotes: DataFrame, passages: DataFrame, lines: DataFrame) -> DataFrame:
    """quotes (query_id, span_id, ref, quoted, from, to) to provisions (query_id, span_id, id, quoted).

    passages: query_id, ref, text; lines: query_id, ref, id, start, end.
    Dropped: unknown refs, text that is not what the passage says, ranges that
    touch a mark only.  Without offsets a quotation stands for its passage (id null).
    """
    known = quotes.join(passages, ["query_id", "ref"])
    ranged = known.where(F.col("from").isNotNull() & matches(F.col("text"), F.col("quoted"), F.col("from"), F.col("to")))
    placed = overlap(ranged, lines, ["query_id", "ref"], ["start"]).select("query_id", "span_id", "id", "quoted")
    whole = known.where(F.col("from").isNull()).select("query_id", "span_id", F.lit(None).cast("string").alias("id"), "quoted")
    return placed.unionByName(whole)


def ref(rank: Column) -> Column:
    """How a passage is called in requests and answers: D1 for the first."""
    return F.concat(F.lit("D"), rank.cast("string"))


def anchors(answer: Column) -> Column:
    """Distinct [Dn] marks in order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(D\d+)\]"), 1))


def abstains(answer: Column) -> Column:
    return F.startswith(F.upper(F.trim(answer)), F.lit(ABSTAINS))


def contained(texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, item_id, at): where a text holds a quotation, at its first place (from 1).

    Candidates share the quotation's longest inner word (its first and last may
    be parts of words of the text); containment is checked on those alone.  A
    quotation without an inner word is met by what its first word ends (two
    words) or by what its only word is part of; blank quotations are left out.
    """
    words = F.split(F.col("text"), " ")
    inner = F.filter(words, lambda w, i: (i > 0) & (i < F.size(words) - 1) & (w != ""))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = quotes.select("item_id", F.col("text").alias("quote"), longest.alias("word"), words.alias("_w")).where(F.trim("text") != "")
    held = texts.select("doc_id", F.explode(F.array_distinct(words)).alias("word"))
    met = held.join(asked.where("word IS NOT NULL"), "word").select("doc_id", "item_id", "quote")
    short = asked.where("word IS NULL")
    # the words of the texts that a short quotation may touch: those that end like its first word, begin like its last or hold its only one
    edge = F.when(F.size("_w") == 1, F.lit("in")).when(F.col("_w")[0] != "", F.lit("end")).otherwise("start")
    part = F.when(F.col("_w")[0] != "", F.col("_w")[0]).otherwise(F.element_at("_w", -1))
    keys = short.select("item_id", "quote", edge.alias("edge"), part.alias("part"), F.length(part).alias("n")).where("part <> ''")
    if not keys.isEmpty():
        sizes = keys.select("edge", "n").distinct()  # a row for each length
        words_of = held.select("word").distinct().withColumn("_l", F.length("word")).join(F.broadcast(sizes), F.col("n") <= F.col("_l"))
        starts = F.when(F.col("edge") == "in", F.sequence(F.lit(1), F.col("_l") - F.col("n") + 1)).when(F.col("edge") == "end", F.array(F.col("_l") - F.col("n") + 1)).otherwise(F.array(F.lit(1)))
        pieces = words_of.withColumn("_s", F.explode(starts)).select("word", "edge", F.expr("substring(word, _s, n)").alias("part")).distinct()
        near = pieces.join(keys, ["edge", "part"]).select("word", "item_id", "quote").distinct()
        met = met.union(held.join(near, "word").select("doc_id", "item_id", "quote"))
    met = met.distinct()
    at = F.instr(F.col("text"), F.col("quote"))
    return met.join(texts.select("doc_id", "text"), "doc_id").where(at > 0).select("doc_id", "item_id", at.alias("at"))
