"""The index: chunks of stored provisions with their vectors, replaced norm by norm."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import schema
from quarry.operators import chunk, search
from quarry.sources.store import Store


def build(store: Store, encode: Callable[[str], Column], model: str, dimension: int, norms: DataFrame | None = None, strategy: str = "dispositivo") -> DataFrame:
    """(norm_urn, chunks, removed): indexes norms (norm_urn), or all that were ingested, anew.

    Texts stay in the store: a chunk has the id and the hash of its text, its
    window and the vector of its indexed text.  One job replaces what all of
    the norms had, so nothing of an earlier wording is found any more; a norm
    that has no chunk now keeps none.  A norm that is not stored is an error.
    """
    store.open_index(model, dimension)
    known = store.read("norm")
    # norms are few beside their rows: dealt by norm, a task would read all rows of one
    wanted = search.sent((store.read("ingest_log") if norms is None else norms).select("norm_urn").distinct())
    own = lambda rows: rows.join(wanted, "norm_urn", "left_semi")
    if unknown := wanted.join(known, F.col("norm_urn") == F.col("urn"), "left_anti").first():
        raise schema.UnknownNorm(f"{unknown['norm_urn']} is not stored")
    before = own(store.live("chunk")).select("norm_urn", F.col("rows").alias("removed"))
    chunks = chunk.strategy(strategy)(own(store.read("provision")), known)
    encoded = chunks.withColumns({"vector": encode("indexed_text").cast("array<float>"), "build": F.lit(uuid.uuid4().hex)})
    store.replace("chunk", encoded.select(*schema.CHUNK.fieldNames()), wanted)
    after = store.live("chunk").select("norm_urn", F.col("rows").alias("chunks"))
    report = wanted.join(after, "norm_urn", "left").join(before, "norm_urn", "left")
    return report.na.fill(0, ["chunks", "removed"]).select("norm_urn", "chunks", "removed")
