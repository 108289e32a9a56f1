"""Evaluation of retrieval and answers over annotated questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import without_versions

#: Cut-offs, characters per token, least output tokens, price factor of cached input.
KS, CHARS_PER_TOKEN, MIN_OUTPUT, CACHED = (5, 10, 20), 3.0, 500, 0.1


def hits(expected: DataFrame, rankings: DataFrame) -> DataFrame:
    """(item, expected, position): the first passage (from 1) that covers each expected id; null if none.

    expected: item, expected; rankings: item, position, covered.  Ids carry no version marks.
    """
    first = rankings.groupBy("item", F.col("covered").alias("expected")).agg(F.min("position").alias("position"))
    return expected.join(first, ["item", "expected"], "left")


def recall_and_mrr(found: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(item, recall_k..., mrr): k counts passages; items without expectations are added by ``with_nothing_expected``."""
    share = [F.round(F.avg((F.coalesce("position", F.lit(1 << 30)) <= k).cast("double")), 6).alias(f"recall_{k}") for k in ks]
    return found.groupBy("item").agg(*share, F.round(F.coalesce(1.0 / F.min("position"), F.lit(0.0)), 6).alias("mrr"))


def with_nothing_expected(measured: DataFrame, items: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Measures of all ``items``: one that expects nothing has found all of it (1.0)."""
    names = [*[f"recall_{k}" for k in ks], "mrr"]
    return items.select("item").distinct().join(measured, "item", "left").select("item", *[F.coalesce(n, F.lit(1.0)).alias(n) for n in names])


def citation_accuracy(cited: DataFrame, expected: DataFrame, items: DataFrame) -> DataFrame:
    """(item, cited, right, accuracy): the share of an item's citations that lie within what it expects; 0.0 without any, for an answer must cite.

    cited: item, cited; expected: item, expected.  Each citation counts, also
    where two name one provision; null ones do not.  Wordings do not matter.  A
    citation lies within an expected provision if that is one of the ids that
    stand above it, so this is a join on ids, of which each has a few above it.
    """
    own = cited.select("item", without_versions(F.col("cited")).alias("cited")).where("cited IS NOT NULL").groupBy("item", "cited").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("cited", "_")
    above = own.select("item", "cited", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "_"))).alias("expected"))
    right = above.join(expected.select("item", without_versions(F.col("expected")).alias("expected")).distinct(), ["item", "expected"], "left_semi").select("item", "cited", "n").distinct()
    counts = lambda df, name: df.groupBy("item").agg(F.sum("n").alias(name))
    both = items.select("item").distinct().join(counts(own, "cited"), "item", "left").join(counts(right, "right"), "item", "left").na.fill(0, ["cited", "right"])
    return both.withColumn("accuracy", F.coalesce(F.round(F.col("right") / F.nullif(F.col("cited"), F.lit(0)), 6), F.lit(0.0)))


def rates(items: DataFrame, group: list[str], measures: dict[str, tuple[Column, Column]], empty: dict[str, float | None] | None = None) -> DataFrame:
    """(group..., items, measures...): for each measure (among, of) the mean of ``of`` over the rows for which ``among`` holds, in one pass.

    Where no row counts, a measure is what ``empty`` says, 0.0 if it says nothing.
    """
    unset = empty or {}
    mean = lambda name, among, of: F.round(F.coalesce(F.avg(F.when(among, of.cast("double"))), F.lit(unset.get(name, 0.0)).cast("double")), 6).alias(name)
    return items.groupBy(*group).agg(F.count(F.lit(1)).alias("items"), *[mean(n, *m) for n, m in measures.items()])


def abstention(items: DataFrame, group: list[str] = []) -> DataFrame:  # noqa: B006
    """How answers abstain (abstained boolean) where they should (should boolean): rates by ``group``, 0.0 where nothing counts."""
    should, did = F.col("should"), F.col("abstained")
    measures = {"abstained_rightly": (should, did), "abstained_wrongly": (~should, did), "agreement": (F.lit(True), should == did), "_share": (F.lit(True), should)}
    found = rates(items, group, measures)
    return found.withColumn("unanswerable", F.round(F.col("_share") * F.col("items")).cast("long")).select(*group, "items", "unanswerable", "abstained_rightly", "abstained_wrongly", "agreement")


def differences(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., kind): what both have, what is missing and what was not expected; each key once."""
    both = expected.select(*keys, F.lit(1).alias("_e")).unionByName(found.select(*keys, F.lit(2).alias("_e"))).groupBy(*keys).agg(F.sum_distinct(F.col("_e")).alias("_s"))
    return both.select(*keys, F.element_at(F.array(F.lit("missing"), F.lit("unexpected"), F.lit("both")), F.col("_s").cast("int")).alias("kind"))


def models_used(calls: DataFrame) -> DataFrame:
    """The distinct models of some calls, in order, as one list."""
    return calls.agg(F.array_sort(F.collect_set("model")).alias("models"))


def missing(found: DataFrame, k: int) -> DataFrame:
    return found.where(F.coalesce("position", F.lit(1 << 30)) > k).select("item", "expected")


def report(items: DataFrame, group: str, measures: list[str]) -> DataFrame:
    """Means over all items and by ``group`` in one pass; level tells which (all, group)."""
    return items.groupingSets([[], [group]], group).agg(
        F.when(F.grouping(group) == 1, "all").otherwise("group").alias("level"), F.count(F.lit(1)).alias("items"), *[F.round(F.avg(m), 6).alias(m) for m in measures]
    )


def price(prices: DataFrame, calls: DataFrame) -> DataFrame:
    """Each call with the price row of the longest prefix of its model; null if there is none."""
    # prefixes of the few distinct models are matched by equality, not each model against each prefix
    models = calls.select("model").distinct()
    parts = models.select("model", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("model"), F.lit(1))), lambda n: F.substring(F.col("model"), F.lit(1), n))).alias("prefix"))
    best = parts.join(prices, "prefix").groupBy(F.col("model").alias("_m")).agg(F.max_by(F.struct("input", "output"), F.length("prefix")).alias("_p"))
    return calls.join(best, F.col("model") == F.col("_m"), "left").select(*calls.columns, F.col("_p.input").alias("input_price"), F.col("_p.output").alias("output_price"))


def cost(tokens_in: Column, tokens_cached: Column, tokens_out: Column, input_price: Column, output_price: Column) -> Column:
    """Price of a call; null for an unknown model."""
    return (tokens_in * input_price + tokens_cached * input_price * CACHED + tokens_out * output_price) / 1_000_000


def total_or_null(c: Column) -> Column:
    """The sum, or null if any part of it is unknown."""
    return F.when(F.max(c.isNull()), F.lit(None)).otherwise(F.sum(c))


def estimated_tokens(characters: Column) -> Column:
    return F.floor(characters / CHARS_PER_TOKEN).cast("long")


def estimated_output(characters: Column) -> Column:
    """Tokens that an answer is reckoned to take: those of its text, a fixed number at least."""
    return F.greatest(estimated_tokens(characters), F.lit(MIN_OUTPUT).cast("long"))


def validate_gold(gold: DataFrame, provisions: DataFrame) -> DataFrame:
    """(id, fault, expected) of items that contradict themselves or the corpus.

    provisions: base_id, valid_from, revoked_on.
    """
    from quarry.operators.temporal import in_force

    wanted = F.size(F.coalesce("dispositivos_esperados", F.array().cast("array<string>")))
    none = F.lit(None).cast("string").alias("expected")
    contradiction = gold.where(F.col("deve_abster") & (wanted > 0)).select("id", F.lit("contradiction").alias("fault"), none)
    empty = gold.where(~F.col("deve_abster") & (wanted == 0)).select("id", F.lit("nothing expected").alias("fault"), none)
    each = gold.select("id", "data_referencia", F.explode("dispositivos_esperados").alias("expected"))
    known = each.join(provisions, each["expected"] == provisions["base_id"], "left")
    alive = known.groupBy("id", "expected").agg(F.max(F.col("base_id").isNotNull()).alias("there"), F.max(F.coalesce(in_force(F.col("data_referencia")), F.lit(False)) & F.col("base_id").isNotNull()).alias("alive"))
    absent = alive.where(~F.col("there")).select("id", F.lit("not in corpus").alias("fault"), "expected")
    late = alive.where(F.col("there") & ~F.col("alive")).select("id", F.lit("not in force").alias("fault"), "expected")
    return contradiction.unionByName(empty).unionByName(absent).unionByName(late)
