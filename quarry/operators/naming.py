"""How norms and provisions are shown: labels, addresses, previews, and one step along links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import dotted, norm_of, urn_parts
from quarry.operators.tree import closure
from quarry.schema import CATALOGUE, CITABLE, COMPONENT


def _known(urn: Column, field: int) -> Column:
    """A field of the catalogue by norm id; null for norms outside it."""
    out = F.lit(None).cast("string")
    for entry in CATALOGUE:
        out = F.when(norm_of(urn) == entry[0], F.lit(entry[field])).otherwise(out)
    return out


def norm_label(urn: Column) -> Column:
    """"Lei 8.078/1990" for the id of a norm or of a provision of it."""
    parts = urn_parts(norm_of(urn))
    year = F.coalesce(F.year(parts["date"]).cast("string"), F.lit("?"))
    number = F.coalesce(dotted(F.try_to_number(parts["number"], F.lit("999999999999"))), parts["number"])
    general = F.when(parts["type"] == "constituicao", F.concat(F.lit("Constituição Federal de "), year)).otherwise(F.concat(F.initcap(parts["type"]), F.lit(" "), number, F.lit("/"), year))
    return F.coalesce(_known(urn, 2), general)


def full_labels(nodes: DataFrame) -> DataFrame:
    """(norm_urn, path, full_label): "Lei 8.078/1990, Art. 6º, VIII".

    Only citable levels are named, and a head text only where nothing follows it.
    """
    chain = closure(nodes, own=True, scope=["norm_urn"])
    known = nodes.select("norm_urn", F.col("path").alias("ancestor"), "type", "label")
    named = chain.join(known, ["norm_urn", "ancestor"]).where(F.col("type").isin(*CITABLE) & ((F.col("type") != "caput") | (F.col("distance") == 0)))
    items = F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("d"), "label")))
    gathered = named.groupBy("norm_urn", "path").agg(F.transform(items, lambda x: x["label"]).alias("_l"))
    head = F.array(norm_label(F.col("norm_urn")))
    part = F.when(F.startswith("path", F.lit(COMPONENT + "/")), F.array(F.lit(COMPONENT.upper()))).otherwise(F.array().cast("array<string>"))
    labels = F.concat(head, part, F.coalesce("_l", F.array().cast("array<string>")))
    return nodes.select("norm_urn", "path").join(gathered, ["norm_urn", "path"], "left").select("norm_urn", "path", F.array_join(labels, ", ").alias("full_label"))


def with_source_url(rows: DataFrame, norms: DataFrame) -> DataFrame:
    """Adds source_url: that of the stored norm, else of the catalogue, else ''."""
    stored = norms.select(F.col("urn").alias("_urn"), F.col("source_url").alias("_url"))
    joined = rows.join(stored, F.col("norm_urn") == F.col("_urn"), "left")
    return joined.select(*rows.columns, F.coalesce("_url", _known(F.col("norm_urn"), 3), F.lit("")).alias("source_url"))


def linked(hits: DataFrame, links: DataFrame) -> DataFrame:
    """(query_id, id): provisions one resolved link away from the hits (query_id, id), hits left out."""
    out = hits.join(links.where("resolved"), F.col("id") == F.col("origin_id")).select("query_id", F.col("target_id").alias("id")).distinct()
    return out.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")


def preview(text: Column, lines: int = 3, width: int = 100) -> Column:
    """The first lines of a text, cut, and how many more there are."""
    parts = F.split(text, "\n")
    more = F.size(parts) - lines
    shown = F.array_join(F.transform(F.slice(parts, 1, lines), lambda x: F.substring(x, 1, width)), "\n")
    return F.when(more > 0, F.concat(shown, F.lit("\n+"), more.cast("string"), F.lit(" lines"))).otherwise(shown)


def as_json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row, nulls included, for a text sink."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
