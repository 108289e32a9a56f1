"""Trees by materialised path: a closure table turns them into equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def prefixes(path: Column, own: bool = False) -> Column:
    """Paths of all ancestors from the root down; the node's own last if ``own``."""
    s = segments(path)
    all_ = F.transform(s, lambda _, i: F.array_join(F.slice(s, 1, i + 1), "/"))
    return all_ if own else F.filter(all_, lambda p: p != F.array_join(s, "/"))


def parent_path(path: Column) -> Column:
    return F.nullif(F.regexp_replace(path, "/?[^/]*$", ""), F.lit(""))


def closure(nodes: DataFrame, own: bool = False, scope: list[str] | None = None) -> DataFrame:
    """(scope..., path, ancestor, distance): a row for each node and ancestor path, whether that is a node or not."""
    scope = scope or []
    depth = F.size(segments(F.col("path")))
    pairs = nodes.select(*scope, "path", F.explode(prefixes(F.col("path"), own)).alias("ancestor"), depth.alias("_depth"))
    return pairs.select(*scope, "path", "ancestor", (F.col("_depth") - F.size(segments(F.col("ancestor")))).alias("distance"))


def ancestors(nodes: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Closure rows whose ancestor is a node."""
    scope = scope or []
    known = nodes.select(*scope, F.col("path").alias("ancestor"))
    return closure(nodes, scope=scope).join(known, [*scope, "ancestor"], "left_semi")


def subtree(nodes: DataFrame, roots: DataFrame, keep: Column | None = None, scope: list[str] | None = None) -> DataFrame:
    """(scope..., root, path): nodes strictly below each of ``roots`` (column path) for which ``keep`` holds."""
    scope = scope or []
    below = nodes.where(keep) if keep is not None else nodes
    found = closure(below, scope=scope).withColumnRenamed("ancestor", "root")
    return found.join(roots.select(*scope, F.col("path").alias("root")), [*scope, "root"], "left_semi").select(*scope, "root", "path")


def nearest_of_type(nodes: DataFrame, types: list[str], scope: list[str] | None = None) -> DataFrame:
    """(scope..., path, nearest): the closest node of a type on the way up, itself included; null if none."""
    scope = scope or []
    typed = nodes.where(F.col("type").isin(*types)).select(*scope, F.col("path").alias("ancestor"))
    best = closure(nodes, own=True, scope=scope).join(typed, [*scope, "ancestor"]).groupBy(*scope, "path").agg(F.min_by("ancestor", "distance").alias("nearest"))
    return nodes.select(*scope, "path").join(best, [*scope, "path"], "left")


def document_order(nodes: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Adds doc_key: sorting by it gives reading order, siblings by (ordinal, path).

    A node whose direct parent is missing starts a tree of its own, even if an
    older ancestor is there: the chain stops at the first gap.
    """
    scope = scope or []
    known = nodes.select(*scope, F.col("path").alias("ancestor"), F.col("ordinal").alias("_o"))
    chain = closure(nodes, own=True, scope=scope).join(known, [*scope, "ancestor"])
    gathered = chain.groupBy(*scope, "path").agg(F.sort_array(F.collect_list(F.struct("distance", "_o", "ancestor"))).alias("_c"))
    # distances run 0, 1, 2, ... up to the first gap
    unbroken = F.filter(F.transform("_c", lambda x, i: F.struct((x["distance"] == i).alias("ok"), x["_o"].alias("ordinal"), x["ancestor"].alias("path"))), lambda x: x["ok"])
    key = F.reverse(F.transform(unbroken, lambda x: F.struct(x["ordinal"], x["path"])))
    return nodes.join(gathered.select(*scope, "path", key.alias("doc_key")), [*scope, "path"])


def prune_empty(nodes: DataFrame, structural: Column, leaf: Column, scope: list[str] | None = None) -> DataFrame:
    """Drops structural nodes with no leaf below, and hangs what is left on the nearest surviving ancestor (parent_path)."""
    scope = scope or []
    held = closure(nodes.where(leaf), scope=scope).select(*scope, F.col("ancestor").alias("path")).distinct()
    marked = nodes.join(held.withColumn("_held", F.lit(True)), [*scope, "path"], "left")
    kept = marked.where(~structural | F.col("_held")).drop("_held")
    best = ancestors(kept, scope).groupBy(*scope, "path").agg(F.min_by("ancestor", "distance").alias("parent_path"))
    return kept.drop("parent_path").join(best, [*scope, "path"], "left")
