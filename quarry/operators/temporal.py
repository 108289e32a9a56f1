"""Validity in time: half-open windows [start, end), version chains and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_force(at: Column, start: str | Column = "valid_from", end: str | Column = "revoked_on", include_revoked: bool = False) -> Column:
    """Whether a window holds ``at``.  No start: since always; no end: still.

    ``include_revoked`` drops the condition on the end alone.
    """
    start, end = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    begun = start.isNull() | (start <= at)
    return begun if include_revoked else begun & (end.isNull() | (end > at))


def search_filter(at: Column | None, norms: list[str] | None = None, types: list[str] | None = None, include_revoked: bool = False) -> Column:
    """Predicate of a search leg: in force (at any time, without ``at``), and of the wanted norms and types."""
    wanted = F.lit(True) if at is None else in_force(at, include_revoked=include_revoked)
    if norms:
        wanted = wanted & F.col("norm_urn").isin(*norms)
    if types:
        wanted = wanted & F.col("type").isin(*types)
    return wanted


def version_chain(df: DataFrame, keys: list[str], start: str, order: list[str], end: str = "valid_to") -> DataFrame:
    """Adds version (from 1), ``end`` (the start of the next version) and is_current.

    Versions of one start give the earlier of them an empty window.
    """
    by_key = Window.partitionBy(*keys).orderBy(start, *order)
    following = F.lead(start).over(by_key)
    return df.withColumn("version", F.row_number().over(by_key)).withColumn(end, following).withColumn("is_current", F.lead(F.lit(1)).over(by_key).isNull())


def validity(df: DataFrame, base: list[str], pos: str, published: Column) -> DataFrame:
    """Start and end of wordings from their notes: needs year, action, struck and text.

    The end is the year of a repeal, else the start of the next wording, else
    the year of what struck it; a year stands for its first of January and
    publication for a missing year.
    """
    from quarry.functions.text import is_repeal_mark

    noted = F.coalesce(F.make_date(F.col("year"), F.lit(1), F.lit(1)), published)
    by_base = Window.partitionBy(*base).orderBy(pos)
    revoked = F.coalesce(F.col("action").startswith("revogad"), F.lit(False)) | is_repeal_mark(F.coalesce("text", F.lit("")))
    following = F.lead("valid_from").over(by_base)
    end = F.when(revoked, noted).when(following.isNotNull(), following).when(F.col("struck"), noted)
    return df.withColumn("valid_from", noted).withColumn("revoked_on", end)


def as_of_join(probes: DataFrame, versions: DataFrame, keys: list[str], at: str, start: str, columns: list[str], tie: list[str], bucket_days: int = 7) -> DataFrame:
    """Left join of each probe to the last version of its key that had started.

    Rows are dealt by key and time bucket, so that one key's whole history never
    meets in a task; the last version of earlier buckets is carried over by a
    window on one row for each key and bucket.  ``tie`` orders versions of one
    start.  Null keys and null times match nothing.
    """
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / (86400 * bucket_days))
    version = F.struct(F.col(start).alias("_start"), *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(tie)], *[F.col(c).alias(c) for c in columns])
    known = versions.where(F.col(start).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], bucket(start).alias("_b"), version.alias("_v"))
    ks = [f"_k{i}" for i in range(len(keys))]
    asked = probes.select(F.struct(*probes.columns).alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], bucket(at).alias("_b"), F.col(at).alias("_at"))
    closing = known.groupBy(*ks, "_b").agg(F.max("_v").alias("_last")).withColumn("_probe", F.lit(0))
    touched = asked.select(*ks, "_b").distinct().withColumn("_last", F.lit(None).cast(closing.schema["_last"].dataType)).withColumn("_probe", F.lit(1))
    carried = Window.partitionBy(*ks).orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
    opening = closing.unionByName(touched).withColumn("_open", F.max("_last").over(carried)).where("_probe = 1").select(*ks, "_b", "_open")
    kinds = known.schema["_v"].dataType
    stream = known.select(*ks, "_b", F.col("_v._start").alias("_at"), F.lit(0).alias("_kind"), "_v", F.lit(None).cast(asked.schema["_p"].dataType).alias("_p"))
    stream = stream.unionByName(asked.select(*ks, "_b", "_at", F.lit(1).alias("_kind"), F.lit(None).cast(kinds).alias("_v"), "_p"))
    before = Window.partitionBy(*ks, "_b").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    here = stream.withColumn("_in", F.max("_v").over(before)).where("_kind = 1").select(*ks, "_b", "_p", "_in")
    joined = here.join(opening, [here[k].eqNullSafe(opening[k]) for k in ks] + [here["_b"].eqNullSafe(opening["_b"])], "left")
    found = F.when(F.concat(*[here[k].cast("string") for k in ks]).isNotNull() & here["_b"].isNotNull(), F.coalesce(here["_in"], opening["_open"]))
    return joined.select(here["_p"].alias("_p"), found.alias("_f")).select("_p.*", F.col("_f._start").alias(f"{start}_found"), *[F.col(f"_f.{c}").alias(c) for c in columns])
