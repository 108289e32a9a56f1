"""From hits to readable passages: targets, budget, omission marks, offsets, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import has_content, line_of
from quarry.operators.temporal import in_force
from quarry.operators.tree import document_order, nearest_of_type, subtree

#: Characters of a passage, and the mark of an omission.
MAX_CHARS, MARK = 8000, "[…]"


def with_targets(nodes: DataFrame, level: str = "article") -> DataFrame:
    """Adds target_path: what a hit expands to.

    none: itself; article: its article, else itself; section: its section or
    subsection, else its article, else itself.
    """
    if level == "none":
        return nodes.withColumn("target_path", F.col("path"))
    article = nearest_of_type(nodes, ["artigo"], ["norm_urn"]).withColumnRenamed("nearest", "_article")
    out = nodes.join(article, ["norm_urn", "path"], "left")
    section = F.lit(None).cast("string")
    if level == "section":
        out = out.join(nearest_of_type(nodes, ["secao", "subsecao"], ["norm_urn"]).withColumnRenamed("nearest", "_section"), ["norm_urn", "path"], "left")
        section = F.col("_section")
    return out.withColumn("target_path", F.coalesce(section, "_article", "path")).drop("_article", "_section")


def budget(lines: DataFrame, group: list[str], order: list[str], size: Column, reserved: Column, limit: int = MAX_CHARS) -> DataFrame:
    """Adds kept: reserved lines always; others in order until the first that would go over, then no more.

    Sizes are positive, so running sums never fall and one comparison says
    whether any line up to here went over.
    """
    whole, upto = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.sum(F.when(reserved, size).otherwise(0)).over(whole)
    running = F.sum(F.when(reserved, 0).otherwise(size)).over(upto)
    return lines.withColumn("kept", reserved | (held + running <= limit))


def with_marks(lines: DataFrame, group: list[str], order: list[str], text: str = "line") -> DataFrame:
    """Kept lines alone; mark_before tells where lines were left out since the kept line before."""
    by = Window.partitionBy(*group).orderBy(*order)
    numbered = lines.withColumn("_pos", F.row_number().over(by)).where("kept")
    gap = F.col("_pos") - F.lag("_pos").over(by)
    return numbered.withColumn("mark_before", F.coalesce(gap > 1, F.lit(False))).drop("_pos")


def with_offsets(lines: DataFrame, group: list[str], order: list[str], text: str = "line") -> DataFrame:
    """Adds start and end of each kept line in its passage; a mark is a line of its own."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("mark_before"), F.lit(len(MARK) + 1)).otherwise(0)
    start = F.coalesce(F.sum(F.length(text) + 1 + mark).over(before), F.lit(0)) + mark
    return lines.withColumn("start", start.cast("long")).withColumn("end", (start + F.length(text)).cast("long"))


def passages(lines: DataFrame, group: list[str], order: list[str], text: str = "line", ids: str | None = None) -> DataFrame:
    """One text for each group, marks included; provisions lists ``ids`` in order."""
    shown = F.when(F.col("mark_before"), F.concat(F.lit(MARK + "\n"), F.col(text))).otherwise(F.col(text))
    items = F.sort_array(F.collect_list(F.struct(*order, shown.alias("_t"), *([F.col(ids).alias("_id")] if ids else []))))
    out = [F.array_join(F.transform(items, lambda x: x["_t"]), "\n").alias("text")]
    if ids:
        out.append(F.transform(items, lambda x: x["_id"]).alias("provisions"))
    return lines.groupBy(*group).agg(*out)


def overlap(spans: DataFrame, lines: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each span (span_id, from, to) to the line of its passage that it overlaps most; the first wins ties."""
    both = spans.join(lines, key).withColumn("shared", F.least("to", "end") - F.greatest("from", "start")).where("shared > 0")
    best = both.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "span_id").orderBy(F.desc("shared"), *order)))
    return best.where("_n = 1").drop("_n")


def first_seen(hits: DataFrame, query: list[str], group: list[str], more: list[Column] = []) -> DataFrame:  # noqa: B006
    """Groups of the ranked hits of each query: best (the first rank), score (the highest), found (hits), and ``more``."""
    return hits.groupBy(*query, *group).agg(F.min("rank").alias("best"), F.max("score").alias("score"), F.count(F.lit(1)).alias("found"), *more)


def in_order_of_best(groups: DataFrame, query: list[str], group: list[str]) -> DataFrame:
    """Adds rank: groups of a query in the order of their best hit, ties by ``group``."""
    return groups.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy("best", *group)))


def expand(hits: DataFrame, nodes: DataFrame, at: Column, level: str = "article", limit: int = MAX_CHARS) -> DataFrame:
    """(query_id, rank, target_path, text, provisions, score, fusion_score, rerank_score): passages of all queries.

    hits: query_id, norm_urn, path, rank, score, rerank_score.  A target is
    kept even if it is no longer in force; what lies below it is filtered, by
    ``at`` or, if the hits have a column date, by that of their query.  Groups
    come in the order of their best hit.
    """
    dated = "date" in hits.columns
    placed = document_order(nodes, ["norm_urn"])
    targets = with_targets(nodes, level).select("norm_urn", "path", "target_path")
    found = hits.join(targets, ["norm_urn", "path"])
    own = ["norm_urn", "target_path", *(["date"] if dated else [])]
    groups = first_seen(found, ["query_id"], own, [F.max("rerank_score").alias("rerank_score"), F.collect_set("path").alias("_hits")]).withColumnRenamed("score", "fusion_score").drop("found")
    wanted = groups.select("norm_urn", F.col("target_path").alias("path")).distinct()
    if level == "none":
        members = wanted.select("norm_urn", F.col("path").alias("root"), "path")
    else:
        members = subtree(nodes, wanted, None if dated else in_force(at), ["norm_urn"]).unionByName(wanted.select("norm_urn", F.col("path").alias("root"), "path"))
    rows = members.join(placed, ["norm_urn", "path"]).where(has_content(F.col("text")) | (F.col("path") == F.col("root")))
    lines = groups.join(rows.withColumnRenamed("root", "target_path"), ["norm_urn", "target_path"])
    if dated:
        lines = lines.where(in_force(F.col("date")) | (F.col("path") == F.col("target_path")))
    lines = lines.withColumn("line", line_of(F.col("type"), F.col("label"), F.col("text")))
    reserved = (F.col("path") == F.col("target_path")) | F.array_contains("_hits", F.col("path"))
    group = ["query_id", "norm_urn", "target_path"]
    marked = with_marks(budget(lines, group, ["doc_key"], F.length("line") + 1, reserved, limit), group, ["doc_key"])
    texts = passages(marked, group, ["doc_key"], ids="id")
    out = in_order_of_best(texts.join(groups.drop("_hits", "date"), group), ["query_id"], ["norm_urn", "target_path"])
    return out.withColumn("score", F.coalesce("rerank_score", "fusion_score")).drop("best")
