"""Raw documents and their records: bytes beside a small JSON file that says where they came from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.schema import CATALOGUE, DownloadFailed, ParserUnavailable

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("urn", "url", "content_type", "sha256", "fetched_at")] + [T.StructField("bytes", T.LongType())])
#: A source gives (url, content type, bytes) for an address.
Fetch = Callable[[str], tuple[str, bytes]]


def file_name(urn: str) -> str:
    return "".join(c if c.isalnum() or c in "-_" else "_" for c in urn)


def save(spark: SparkSession, folder: str, urn: str, url: str, content_type: str, content: bytes, suffix: str = "htm") -> str:
    """Writes a document and its record through Hadoop's file systems; the path of the document."""
    if not content:
        raise DownloadFailed(f"nothing came from {url}")
    record = {"urn": urn, "url": url, "content_type": content_type, "sha256": hashlib.sha256(content).hexdigest(), "fetched_at": datetime.now(UTC).isoformat(), "bytes": len(content)}
    base = f"{folder.rstrip('/')}/{file_name(urn)}.{suffix}"
    for path, data in ((base, content), (base + ".meta.json", json.dumps(record, ensure_ascii=False).encode())):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
        out.write(bytearray(data))
        out.close()
    return base


def fetch_all(spark: SparkSession, folder: str, fetch: Fetch, limit: int | None = None) -> list[str]:
    """Downloads the catalogue with an injected fetcher; the engine itself opens no connection."""
    out = []
    for urn, _, _, url, _ in CATALOGUE[:limit]:
        content_type, content = fetch(url)
        out.append(save(spark, folder, urn, url, content_type, content))
    return out


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.htm*").load(folder).where(~F.endswith("path", F.lit(".json"))).select("path", "content")


def records(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.schema(RECORD).option("multiLine", True).option("pathGlobFilter", "*.meta.json").json(folder)
    return rows.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.meta\.json$", "").alias("_path"), "*")


def _plain(path: Column) -> Column:
    """Paths of the two readers in one form: without scheme and slashes before the first folder."""
    return F.regexp_replace(path, r"^[a-z]+:/*", "/")


def quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """(path, urn, reason) of what ``load`` cannot give: documents without a record, records without a document, documents that differ from theirs."""
    both = files(spark, folder).join(records(spark, folder), _plain(F.col("path")) == _plain(F.col("_path")), "full")
    reason = F.when(F.col("_path").isNull(), "no record").when(F.col("path").isNull(), "no document").when(F.sha2("content", 256) != F.col("sha256"), "differs from its record")
    return both.select(F.coalesce("path", "_path").alias("path"), "urn", reason.alias("reason")).where(F.col("reason").isNotNull())


def load(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """(urn, url, content, content_type, sha256, fetched_at) of documents with a record, in order of path.

    A document that is not what its record says makes the read fail; if
    ``strict``, so does anything else that is in ``quarantine``.
    """
    if strict and (found := quarantine(spark, folder).orderBy("path").first()):
        raise DownloadFailed(f"{found['path']}: {found['reason']}")
    both = files(spark, folder).join(records(spark, folder), _plain(F.col("path")) == _plain(F.col("_path")))
    same = F.sha2("content", 256) == F.col("sha256")
    checked = F.when(same, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("document differs from its record: "), F.col("urn"))))
    return both.orderBy("path").select("urn", "url", checked.alias("content"), "content_type", "sha256", "fetched_at")


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without a record."""
    return files(spark, folder).join(records(spark, folder), _plain(F.col("path")) == _plain(F.col("_path")), "left_anti").select("path")


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, a, label, url, list(n)) for u, a, label, url, n in CATALOGUE], "urn string, alias string, label string, source_url string, names array<string>")


PARSERS = {"html": lambda content_type, path: "html" in content_type or path.endswith((".htm", ".html"))}


def choose_parser(content_type: str, path: str) -> str:
    for name, takes in PARSERS.items():
        if takes(content_type, path):
            return name
    raise ParserUnavailable(f"no parser takes {content_type} of {path}")
