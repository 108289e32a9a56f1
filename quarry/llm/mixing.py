"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length, source by source.  A source whose
target is q times its size, plus a rest, gives all its documents q times; the
rest is a subset-sum problem over the length histogram: an even share of each
length first, then single documents from the longest down, then a bounded
knapsack over the small budget that is left, or over more of it as long as the
sum is not met.  Which documents of a length are taken follows a seeded hash.  Only histograms are gathered, never documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_rank, salts_for

#: Budget (tokens) that the dynamic program fits at first; larger rests shrink by whole documents.
EXACT_BUDGET = 8192
#: Sums that it tells apart at most.
MAX_BUDGET = 1 << 24


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null: 0."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    spaces = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit("")))
    inner = F.length(F.btrim(squeezed, F.lit(" "))) > 0
    ends = F.startswith(squeezed, F.lit(" ")).cast("int") + F.endswith(squeezed, F.lit(" ")).cast("int")
    return F.when(inner, spaces + 1 - ends).otherwise(0).cast("long")


def targets(sizes: list[tuple], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> list[float]:
    """Target of each source: ``share`` of all sizes by weight, at most ``most`` times a source's own size.

    ``sizes`` is (name, size) in the order that the weights go round.  What a
    capped source can't take is shared again by weight among the others.
    """
    total = share * sum(n for _, n in sizes)
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    capped: set[int] = set()
    while True:
        left = total - sum(most * sizes[i][1] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        parts = sum(weight[i] for i in free)
        over = {i for i in free if left * weight[i] / parts > most * sizes[i][1]} if parts else set()
        if not over:
            return [most * sizes[i][1] if i in capped else left * weight[i] / parts for i in range(len(sizes))]
        capped |= over


def knapsack(lengths: np.ndarray, supply: np.ndarray, budget: int, over: int = 0) -> np.ndarray:
    """How many of each length, at most ``supply``, to come as near to ``budget`` as can be, at most ``over`` above it.

    Lengths are divided by what they have in common; budgets over MAX_BUDGET
    are fitted in coarser units first, then what is left of them.
    """
    counts = np.zeros(len(lengths), np.int64)
    can = np.flatnonzero((supply > 0) & (lengths > 0) & (lengths <= budget + over))
    if budget + over <= 0 or not len(can):
        return counts
    unit = int(np.gcd.reduce(lengths[can].astype(np.int64)))
    coarse = (budget + over) // unit > MAX_BUDGET
    if coarse:
        unit = -(-(budget + over) // MAX_BUDGET)
    # rounded up, lengths never go over a bound that must hold
    most, steps = (budget + over) // unit, {int(k): max(1, int(lengths[k]) // unit) if coarse and over else -(-int(lengths[k]) // unit) for k in can}
    above = abs((budget // unit + 1) * unit - budget) < budget % unit
    goal = min(most, budget // unit + above)
    first, layers = np.full(most + 1, -1, np.int32), []  # by which layer a sum was reached first
    first[0] = 0
    for k in sorted(steps, key=steps.get, reverse=True):
        left, step = min(int(supply[k]), most // steps[k]), 1
        while left > 0:
            take = min(left, step)
            by = take * steps[k]
            layers.append((k, take))
            new = np.flatnonzero((first[:-by] >= 0) & (first[by:] < 0))
            first[new + by] = len(layers)
            left, step = left - take, step * 2
        if first[goal] >= 0:
            break
    sums = np.flatnonzero(first >= 0)
    room = int(sums[np.argmin(np.abs(sums * unit - budget))])  # of two the lower
    while room:
        k, take = layers[first[room] - 1]
        counts[k] += take
        room -= take * steps[k]
    if coarse and counts.any():
        counts += knapsack(lengths, supply - counts, budget - int((counts * lengths).sum()))
    return counts


def _fit(lengths: np.ndarray, supply: np.ndarray, goal: int, reserve: int) -> np.ndarray:
    """An even share of each length and single documents up to the last ``reserve`` tokens, which the knapsack fits."""
    total = int((lengths * supply).sum())
    counts = np.array([int(n) * max(0, goal - reserve) // total for n in supply], np.int64)  # of Python's integers: the product is beyond 64 bits
    rest = goal - int((counts * lengths).sum())
    for k in np.argsort(lengths, kind="stable")[::-1]:
        if rest <= reserve:
            break
        more = min(int(supply[k] - counts[k]), (rest - reserve) // int(lengths[k]))
        if more > 0:
            counts[k] += more
            rest -= more * int(lengths[k])
    left = lengths[supply > counts]
    return counts + knapsack(lengths, supply - counts, rest, int(left.max()) if len(left) else 0)


def fit(lengths: np.ndarray, supply: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each length to take so that their sum comes near ``budget``, from below or above.

    If the sum is not met with the last EXACT_BUDGET tokens, more and more of
    the budget is left to the knapsack, at last all of it.
    """
    counts = np.zeros(len(lengths), np.int64)
    total, goal = int((lengths * supply).sum()), int(round(budget))
    used = np.flatnonzero((lengths > 0) & (supply > 0))
    if goal <= 0 or not total:
        return counts
    if goal >= total:
        return np.where(lengths > 0, supply, 0)
    own, stock = lengths[used].astype(np.int64), supply[used].astype(np.int64)
    unit, reserve, best = int(np.gcd.reduce(own)), EXACT_BUDGET, None
    while True:
        found = _fit(own, stock, goal, reserve)
        miss = abs(int((found * own).sum()) - goal)
        if best is None or miss < best[0]:
            best = miss, found
        if best[0] <= min(goal % unit, -goal % unit) or reserve >= goal:
            break
        reserve *= 8
    if (best[1] < 0).any() or (best[1] > stock).any():
        raise ArithmeticError("more documents of a length than there are, or fewer than none")
    counts[used] = best[1]
    return counts


def mix(docs: DataFrame, size: Column, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, source: str = "source", id_column: str = "doc_id") -> DataFrame:
    """Columns of ``docs`` plus size, source_size, target and times (how often a document is taken).

    Sources go by code point, null last, and get the weights in turn.  Equal
    rows may be told apart by nothing: which of them is taken is then open,
    and makes no difference.  A source of size 0 has target 0 and its documents
    are not taken; nor are documents of size 0, which add nothing.  Weights
    take the sources one by one, so these, a number each, come to the driver:
    ``source`` should name collections, not addresses.  An empty table gives an
    empty result.  ``docs`` should be a
    written table or a scan: it is read for the histogram and for the choice.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in ("size", "source_size", "target", "times")]
    rows = docs.select(*columns, F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    histogram = rows.groupBy(F.col(source).alias("_source"), "size").agg(F.count(F.lit(1)).alias("_n"))
    per_source = histogram.groupBy("_source").agg(F.sum(F.col("size") * F.col("_n")).alias("n"), F.max("_n").alias("most")).orderBy(F.col("_source").asc_nulls_last()).collect()  # a row for each source
    goals = targets([(r["_source"], int(r["n"])) for r in per_source], weights, share, most)
    plan = spark.createDataFrame([(r["_source"], int(r["n"]), float(t)) for r, t in zip(per_source, goals, strict=True)], "_source string, source_size long, target double")
    known = histogram.join(F.broadcast(plan), histogram["_source"].eqNullSafe(plan["_source"])).select(plan["*"], "size", "_n")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        whole, lengths, supply = int(group["source_size"].iloc[0]), group["size"].to_numpy(), group["_n"].to_numpy()
        goal = float(group["target"].iloc[0])
        times = int(goal // whole) if whole else 0
        extra = fit(lengths, supply, goal - times * whole)
        return group.assign(_times=np.where(lengths > 0, times, 0), _extra=extra)[["_source", "size", "source_size", "target", "_times", "_extra"]]

    chosen = known.groupBy("_source").applyInPandas(choose, "_source string, size long, source_size long, target double, _times long, _extra long")
    order = F.xxhash64(F.lit(seed), F.col(id_column)).alias("_order")
    ids = rows.select("*", order)
    salts = salts_for(max((int(r["most"]) for r in per_source), default=0))
    ranked = salted_rank(ids, [source, "size"], ["_order", id_column], "_rank", salts)
    on = ranked[source].eqNullSafe(chosen["_source"]) & (ranked["size"] == chosen["size"])
    times = (chosen["_times"] + (F.col("_rank") < chosen["_extra"]).cast("long")).alias("times")
    return ranked.join(chosen, on).select(*[ranked[c] for c in [*columns, "size"]], "source_size", "target", times)
