"""The stages that fill a store: documents fetched, ingested, indexed, each from what the one before it stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import urn_parts
from quarry.plans import index
from quarry.sources import documents, html, raw
from quarry.sources.store import Store
from quarry.streaming.ingest import replace_batch


def described(docs: DataFrame) -> DataFrame:
    """Rows of the table of norms for documents (norm_urn, url, sha256): what their ids say, and short names of the catalogue."""
    parts, none = urn_parts(F.col("norm_urn")), F.lit(None).cast("string")
    known = raw.catalogue(docs.sparkSession).select(F.col("urn").alias("norm_urn"), "alias")
    rows = docs.select("norm_urn", "url", "sha256", parts.alias("p")).join(F.broadcast(known), "norm_urn", "left")
    return rows.select(
        F.col("norm_urn").alias("urn"), F.col("p.type").alias("type"), F.col("p.number").alias("number"), F.year("p.date").alias("year"), F.col("p.date").alias("published"),
        "alias", none.alias("summary"), F.col("url").alias("source_url"), F.col("sha256").alias("source_sha256"),
    )


def ingest(spark: SparkSession, folder: str, store: Store, urns: list[str] | None = None, strict: bool = False) -> DataFrame:
    """(norm_urn, provisions, links): raw documents become trees and links of the store, in one commit.

    Links are resolved after all trees are there.  A norm that comes twice is
    taken from the document fetched last.  A document that no parser takes, or
    that differs from its record, is an error and leaves the store as it was.
    With ``urns`` no other document is read.
    """
    rows = documents.read(spark, folder, strict)
    rows = rows if urns is None else rows.where(F.col("urn").isin(urns))
    readable = F.coalesce(F.col("content_type"), F.lit("")).contains("html") | F.col("path").rlike(r"\.html?$")
    content = F.when(readable, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("no parser takes "), "path")))
    day = urn_parts(F.col("urn"))["date"]
    docs = rows.select(F.col("urn").alias("norm_urn"), day.alias("published"), html.decoded(content).alias("html"), F.col("fetched_at").cast("timestamp").alias("at"), "url", "sha256")
    replace_batch(store, described)(docs, 0)
    own = store.read("ingest_log").select("norm_urn")
    own = own if urns is None else own.where(F.col("norm_urn").isin(urns))
    counts = lambda table, name: store.live(table).groupBy("norm_urn").agg(F.sum("rows").alias(name))
    return own.join(counts("provision", "provisions"), "norm_urn", "left").join(counts("xref", "links"), "norm_urn", "left").na.fill(0, ["provisions", "links"])


def total(report: DataFrame) -> DataFrame:
    """One row: how many norms a report has, and the sums of its counts."""
    counts = [c for c in report.columns if c != "norm_urn"]
    return report.agg(F.count(F.lit(1)).alias("norms"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])


def status(spark: SparkSession, folder: str, store: Store) -> DataFrame:
    """(part, name, rows): raw documents by what is wrong with them, tables of the store, the index by its model.

    Counts of tables come from the store's state; an index that is not there,
    or cannot be read, has null rows and is no error.
    """
    faults = raw.quarantine(spark, folder).select("reason")
    good = raw.records(spark, folder).select(F.lit("with record").alias("reason"))
    raws = good.unionByName(faults).groupBy("reason").agg(F.count(F.lit(1)).alias("rows")).select(F.lit("raw").alias("part"), F.col("reason").alias("name"), "rows")
    tables = store.status().select(F.lit("store").alias("part"), F.col("table").alias("name"), "rows")
    try:
        found = [("index", store.read("chunk-record").first()[0], store.count("chunk"))] if store.exists("chunk-record") else [("index", None, None)]
    except Exception as error:  # noqa: BLE001
        found = [("index", type(error).__name__, None)]
    return raws.unionByName(tables).unionByName(spark.createDataFrame(found, "part string, name string, rows long"))


def run(spark: SparkSession, folder: str, store: Store, fetch: raw.Fetch, encode: Callable[[str], Column], model: str, dimension: int, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All stages in turn; the reports of ingestion and index."""
    raw.fetch_all(spark, folder, fetch, limit)
    ingested = ingest(spark, folder, store)
    return ingested, index.build(store, encode, model, dimension)
