"""Provisions by id, by what stands above them, and by wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import normalise, version_of, without_versions
from quarry.operators.search import sent


def by_ids(rows: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose ``key`` is among ``wanted``, each once per row however often it is asked for."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def hydrate(ranked: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Ranked keys with the columns of their rows, after the cut; a key without a row goes."""
    return ranked.join(rows, key)


def with_defaults(left: DataFrame, right: DataFrame, key: str, defaults: dict) -> DataFrame:
    """``left`` with columns of ``right``, and a default where a key has no row or a null there."""
    kept = [F.coalesce(right[c], F.lit(v)).alias(c) for c, v in defaults.items()]
    return left.join(right, left[key] == right[key], "left").select(*[left[c] for c in left.columns], *kept)


def without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The rows of ``left`` whose ``key`` is not in ``right``."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def below(rows: DataFrame, prefixes: DataFrame, separator: str = "_", id_column: str = "id") -> DataFrame:
    """(prefix, columns of rows): rows whose id is one of ``prefixes`` (prefix) or stands below one.

    An id is split at its separators and joined on each of its beginnings, so
    this is a join on equal values, never a comparison of all pairs.
    """
    parts = F.split(id_column, separator)
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))
    return rows.withColumn("prefix", F.explode(starts)).join(prefixes.select("prefix").distinct(), "prefix").select("prefix", *rows.columns)


def wordings(rows: DataFrame, ids: DataFrame, id_column: str = "id") -> DataFrame:
    """All wordings of the wanted ids (id, whatever their own version), the superseded ones first, the current one last; nth counts from 1."""
    base = rows.withColumn("base_id", without_versions(F.col(id_column)))
    wanted = ids.select(without_versions(F.col("id")).alias("base_id")).distinct()
    order = Window.partitionBy("base_id").orderBy(F.coalesce(version_of(F.col(id_column)), F.lit((1 << 31) - 1)))
    return base.join(wanted, "base_id", "left_semi").withColumn("nth", F.row_number().over(order))


def name_tokens(text: Column) -> Column:
    """Words and numbers of a name, without accents and case; null has none."""
    return F.filter(F.split(normalise(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def named_at_start(texts: DataFrame, names: DataFrame, text: str = "text", name: str = "name", urn: str = "urn") -> DataFrame:
    """All columns of ``texts``, and found (what the longest of ``names`` at the start of the text stands for), rest and reason.

    names: name, urn.  Every text is met by its own first words, one row for
    each length that some name has, so names are found by equality however many
    there are.  rest are the words after the name; reason says why none is
    found: "empty" or "no known name".  Of names with the same words the least
    urn counts; a name without words is none.
    """
    known = names.select(name_tokens(F.col(name)).alias("_w"), F.col(urn).alias("_urn")).where(F.size("_w") > 0)
    known = known.groupBy(F.array_join("_w", " ").alias("_key")).agg(F.min("_urn").alias("_urn"), F.max(F.size("_w")).alias("_size"))
    lengths = [r[0] for r in known.select("_size").distinct().orderBy("_size").collect()]  # as many as a name has words, at most
    own = texts.select(F.col(text).alias("_text")).distinct().withColumn("_words", name_tokens(F.col("_text")))
    starts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.size("_words"))
    keys = F.transform(starts, lambda n: F.array_join(F.slice("_words", F.lit(1), n), " "))
    met = own.select("_text", F.explode(keys).alias("_key")).join(sent(known), "_key")
    best = met.groupBy("_text").agg(F.max_by("_urn", "_size").alias("found"), F.max("_size").alias("_n"))
    joined = own.join(best, "_text", "left")
    n = F.coalesce("_n", F.lit(0))
    reason = F.when(n > 0, F.lit(None).cast("string")).when(F.size("_words") == 0, "empty").otherwise("no known name")
    named = joined.select("_text", "found", F.slice("_words", n + 1, F.size("_words")).alias("rest"), reason.alias("reason"))
    return texts.join(named, F.col(text).eqNullSafe(F.col("_text"))).drop("_text")
