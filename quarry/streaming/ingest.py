"""Documents as a stream of files: every batch replaces the norms that it brings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.plans.parse import links, provisions
from quarry.sources.store import Store


def replace_batch(store: Store, described: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """Writes a batch of documents (norm_urn, published, html, at); the latest of a norm counts.

    A batch that runs again writes the same rows to the same partitions.
    ``described`` makes rows of the table of norms from the batch.  The log has
    the hash of the text, or that of the raw document if the batch has one (sha256).
    """

    def run(batch: DataFrame, _: int) -> None:
        newest = Window.partitionBy("norm_urn").orderBy(F.desc("at"), F.desc("html"))
        latest = batch.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n").persist()
        try:
            if latest.isEmpty():
                return
            norms, own = latest.select("norm_urn"), provisions(latest)
            with store.commit() as changes:  # a reader sees the whole batch or nothing of it
                if described:
                    changes.upsert("norm", described(latest), ["urn"])
                changes.put_provisions(own, norms)
                kept = changes.read("provision").join(norms, "norm_urn", "left_semi")
                changes.put_links(links(kept).withColumns({"target_id": F.lit(None).cast("string"), "resolved": F.lit(False)}).select("origin_id", "target_urn", "target_id", "original_text", "resolved"))
                changes.resolve_pending()
                digest = F.col("sha256") if "sha256" in batch.columns else F.sha2("html", 256)
                changes.log(latest.select("norm_urn", digest.alias("source_sha256"), F.col("at").cast("timestamp").alias("at")))
        finally:
            latest.unpersist()

    return run


def ingest_stream(spark: SparkSession, folder: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Follows a folder of JSON lines (norm_urn, published, html, at) until stopped; here one round over what is there."""
    rows = spark.readStream.schema("norm_urn string, published date, html string, at timestamp").json(folder)
    return rows.writeStream.foreachBatch(replace_batch(store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by window and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
