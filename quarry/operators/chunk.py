"""Chunks for indexing: one for each provision, or one for each article with what survives below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import FAR_DATE, FIRST_DATE, day_number, day_or_far, has_content, is_structural, line_of, text_key, uuid5
from quarry.operators.search import sent
from quarry.operators.tree import closure, document_order


def survives(child_end: Column, article_end: Column) -> Column:
    """Whether a child is still alive at the end of its article's window."""
    far = F.lit(FAR_DATE).cast("date")
    return F.coalesce(child_end, far) >= F.coalesce(article_end, far)


def _trail(nodes: DataFrame) -> DataFrame:
    """(norm_urn, path, trail, above): structural headings on the way down, and lines of citable ancestors with content."""
    head = F.concat_ws(" — ", "label", F.nullif(F.trim(F.coalesce("text", F.lit(""))), F.lit("")))
    known = nodes.select("norm_urn", F.col("path").alias("ancestor"), is_structural(F.col("type")).alias("_s"), head.alias("_h"), line_of(F.col("type"), F.col("label"), F.col("text")).alias("_l"), has_content(F.col("text")).alias("_c"))
    chain = closure(nodes, scope=["norm_urn"]).join(known, ["norm_urn", "ancestor"])
    items = F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "_s", "_h", "_l", "_c")))
    gathered = chain.groupBy("norm_urn", "path").agg(items.alias("_i"))
    pick = lambda keep, field: F.transform(F.filter("_i", keep), lambda x: x[field])
    return gathered.select("norm_urn", "path", pick(lambda x: x["_s"], "_h").alias("trail"), pick(lambda x: ~x["_s"] & x["_c"], "_l").alias("above"))


def _rows(base: DataFrame, norms: DataFrame) -> DataFrame:
    start = F.coalesce("valid_from", "published", F.lit(FIRST_DATE).cast("date"))
    named = norms.select(F.col("urn").alias("norm_urn"), F.coalesce("alias", "urn").alias("_alias"), "published")
    return base.join(sent(named), "norm_urn").select(
        uuid5(F.col("id")).alias("chunk_id"), F.col("id").alias("provision_id"), "norm_urn", "path", "type", "chunk_text",
        F.concat_ws("\n", F.array_join(F.concat(F.array("_alias"), F.coalesce("trail", F.array().cast("array<string>"))), " > "), F.nullif(F.array_join(F.coalesce("above", F.array().cast("array<string>")), "\n"), F.lit("")), F.col("chunk_text")).alias("indexed_text"),
        day_number(start).alias("valid_from_day"), day_or_far(F.col("revoked_on")).alias("revoked_on_day"), text_key(F.col("chunk_text")).alias("text_sha256"),
    )


def by_provision(nodes: DataFrame, norms: DataFrame) -> DataFrame:
    """A chunk for each citable node with content; its indexed text adds the trail and its ancestors' lines."""
    own = nodes.where(~is_structural(F.col("type")) & has_content(F.col("text"))).withColumn("chunk_text", line_of(F.col("type"), F.col("label"), F.col("text")))
    return _rows(own.join(_trail(nodes), ["norm_urn", "path"], "left"), norms)


def by_article(nodes: DataFrame, norms: DataFrame) -> DataFrame:
    """A chunk for each article: its line and those of surviving descendants, in document order."""
    placed = document_order(nodes, ["norm_urn"])
    articles = nodes.where("type = 'artigo'").select("norm_urn", F.col("path").alias("ancestor"), F.col("revoked_on").alias("_end"))
    below = closure(nodes, own=True, scope=["norm_urn"]).join(articles, ["norm_urn", "ancestor"]).select("norm_urn", "path", F.col("ancestor").alias("_article"), "_end")
    lines = below.join(placed, ["norm_urn", "path"]).where((F.col("path") == F.col("_article")) | (survives(F.col("revoked_on"), F.col("_end")) & has_content(F.col("text"))))
    lines = lines.withColumn("line", line_of(F.col("type"), F.col("label"), F.col("text")))
    items = F.sort_array(F.collect_list(F.struct("doc_key", "line")))
    texts = lines.groupBy("norm_urn", F.col("_article").alias("path")).agg(F.array_join(F.transform(items, lambda x: x["line"]), "\n").alias("chunk_text"))
    own = nodes.where("type = 'artigo'").join(texts, ["norm_urn", "path"])
    return _rows(own.join(_trail(nodes).select("norm_urn", "path", "trail", F.array().cast("array<string>").alias("above")), ["norm_urn", "path"], "left"), norms).where(has_content(F.col("chunk_text")))


STRATEGIES = {"dispositivo": by_provision, "artigo": by_article}


def strategy(name: str):
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[name]
