"""Order-sensitive operators: ordinals, running maxima, islands, flags, latest and first rows.

What runs over the rows of a key in their order is one window, as long as no key
has more than ``HOT_ROWS`` rows.  Beyond that it is a scan in two levels: rows
are dealt by ranges of key and order, so that a key's rows lie in as many
partitions as they fill; each range is scanned by itself, the totals of a key's
ranges are scanned in turn, and what came before a range is added to its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that a single task may scan.
HOT_ROWS = 1_000_000


def hottest(df: DataFrame, keys: list[str]) -> int:
    """How many rows the most frequent key has."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def in_ranges(df: DataFrame, keys: list[str], order: list[str], name: str = "_range") -> DataFrame:
    """``df`` dealt by ranges of key and order, numbered in that order; written once, so that all readers see the same ranges."""
    from quarry.sources.store import Store

    store = Store.scratch(df.sparkSession)
    store.rewrite("ranges", df.repartitionByRange(*keys, *order).withColumn(name, F.spark_partition_id()))
    return store.read("ranges")


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, merge: Callable[[str], Column], both: Callable[[Column, Column], Column], name: str, upto: int = 0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``merge`` of ``value`` over a key's rows up to this one (``upto`` 0) or the one before it (-1).

    ``both`` puts two results of ``merge`` together; null is that of no value.
    Null keys are a key; rows equal in key and order come in any order.
    """
    valued = df.withColumn("_value", value)
    if hottest(df, keys) <= hot_rows:
        rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
        return valued.withColumn(name, merge("_value").over(rows)).drop("_value")
    placed = in_ranges(valued, keys, order)
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a key
    totals = placed.groupBy("_range", *keys).agg(merge("_value").alias("_total"))
    carried = totals.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], merge("_total").over(before).alias("_carried"))
    scanned = placed.withColumn("_inside", merge("_value").over(inside))
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    own, carry = F.col("_inside"), F.col("_carried")
    result = F.when(own.isNull(), carry).when(carry.isNull(), own).otherwise(both(carry, own))
    return scanned.join(carried, on).withColumn(name, result).select(*df.columns, name)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def sibling_ordinal(df: DataFrame, parent: list[str], order: list[str], name: str = "ordinal", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Numbers the rows of each parent from 1."""
    return running(df, parent, order, F.lit(1), F.sum, _plus, name, hot_rows=hot_rows).withColumn(name, F.col(name).cast("int"))


def running_max_before(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "max_before", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The largest value of a key's earlier rows; null for the first."""
    return running(df, keys, order, F.col(value), F.max, F.greatest, name, upto=-1, hot_rows=hot_rows)


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Numbers runs of rows, each from a row for which ``starts`` holds; 0 before the first."""
    return running(df, keys, order, starts.cast("long"), F.sum, _plus, name, hot_rows=hot_rows)


def flag_from(df: DataFrame, keys: list[str], order: list[str], flag: Column, name: str = "seen", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Whether ``flag`` has held in this row or an earlier one."""
    return running(df, keys, order, F.coalesce(flag, F.lit(False)), F.max, lambda a, b: a | b, name, hot_rows=hot_rows)


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; window group limits cut each partition before the shuffle."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys; of several new ones the last by ``order`` wins."""
    newest = first_of(new, keys, [F.col(c).desc() for c in (order or keys)])
    return old.join(newest.select(*keys), keys, "left_anti").unionByName(newest)


def in_groups_joined(df: DataFrame, keys: list[str], order: list[str], text: str, separator: str = "\n", name: str = "text") -> DataFrame:
    """Texts of each group joined in order."""
    items = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["_t"]), separator).alias(name))


def numbered(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Numbers all rows from 1 in one order: ranges of it give the partitions, counts of earlier ranges where each starts."""
    placed = in_ranges(df, [], order)
    inner = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    starts = placed.groupBy("_range").count().withColumn("_from", F.coalesce(F.sum("count").over(before), F.lit(0))).select("_range", "_from")
    return inner.join(F.broadcast(starts), "_range").select(*df.columns, (F.col("_from") + F.col("_n")).cast("long").alias(name))


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], name: str = "position") -> DataFrame:
    """The n-th row of one table beside the n-th of another, each in its own order; another number of rows is an error.

    Rows equal in all of their order columns come in any order.  The tables have no column in common.
    """
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows cannot be put beside {m}")
    return numbered(left, left_order, name).join(numbered(right, right_order, name), name)
