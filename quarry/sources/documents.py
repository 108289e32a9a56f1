"""Raw documents with their records as a data source of Spark's: ``spark.read.format("raw_documents").load(folder)``."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from quarry.schema import DownloadFailed
from quarry.sources.raw import file_name

RECORD = ".meta.json"
COLUMNS = pa.schema([(n, pa.binary() if n == "content" else pa.string()) for n in ("path", "urn", "url", "content", "content_type", "sha256", "fetched_at")])
#: Bytes of one task's documents, and of one batch that a task hands over.
GROUP_BYTES, BATCH_BYTES = 64 << 20, 8 << 20


@dataclass
class Group(InputPartition):
    """Documents that one task reads."""

    paths: tuple[str, ...]


class RawReader(DataSourceReader):
    """Names are listed once, on the driver; contents and records are read by the tasks alone.

    A document and its record are told by their names, so nothing is shuffled.
    """

    def __init__(self, options: dict) -> None:
        self.folder, self.urns = options["path"], None
        self.group_bytes = int(options.get("groupBytes", GROUP_BYTES))
        self.strict = options.get("strict", "false").lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            if isinstance(one, (EqualTo, In)) and one.attribute == ("urn",):
                asked = frozenset([one.value] if isinstance(one, EqualTo) else one.value)
                self.urns = asked if self.urns is None else self.urns & asked
            else:
                yield one

    def partitions(self) -> list[Group]:
        system, root = FileSystem.from_uri(self.folder)
        sizes = {f.path: f.size or 0 for f in system.get_file_info(FileSelector(root)) if f.is_file and not f.base_name.startswith((".", "_"))}
        records = {p.removesuffix(RECORD) for p in sizes if p.endswith(RECORD)}
        documents = {p for p in sizes if not p.endswith(RECORD)}
        if self.strict and (wrong := min(records ^ documents, default=None)):
            raise DownloadFailed(f"{wrong}: {'no document' if wrong in records else 'no record'}")
        wanted = sorted(records & documents)
        if self.urns is not None:  # two ids may share a file name: the record decides when it is read
            names = {file_name(u) for u in self.urns if u is not None}
            wanted = [p for p in wanted if p.rpartition("/")[2].rpartition(".")[0] in names]
        groups, held = [[]], 0
        for path in wanted:
            if groups[-1] and held + sizes[path] > self.group_bytes:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += sizes[path]
        return [Group(tuple(g)) for g in groups]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        system, _ = FileSystem.from_uri(self.folder)

        def content_of(path: str) -> bytes:
            with system.open_input_stream(path) as file:
                return file.read()

        rows, held = [], 0
        for path in partition.paths:
            record = json.loads(content_of(path + RECORD))
            if self.urns is not None and record.get("urn") not in self.urns:
                continue
            content = content_of(path)
            if hashlib.sha256(content).hexdigest() != record.get("sha256"):
                raise DownloadFailed(f"document differs from its record: {record.get('urn')}")
            rows.append({"path": path, "content": content, **{n: record.get(n) for n in ("urn", "url", "content_type", "sha256", "fetched_at")}})
            held += len(content)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=COLUMNS)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=COLUMNS)


class RawDocuments(DataSource):
    """Options: path (an address or absolute path), groupBytes, strict (fail if any document or record lacks the other)."""

    @classmethod
    def name(cls) -> str:
        return "raw_documents"

    def schema(self) -> str:
        return ", ".join(f"{f.name} {'binary' if f.name == 'content' else 'string'}" for f in COLUMNS)

    def reader(self, schema) -> RawReader:
        return RawReader(self.options)


def read(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """(path, urn, url, content, content_type, sha256, fetched_at) of documents that have a record; filters on urn choose the files.

    A document that is not what its record says makes the read fail.  What has
    no record is left out (``raw.quarantine`` lists it), or fails if ``strict``.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawDocuments)
    return spark.read.format("raw_documents").option("strict", str(strict).lower()).load(folder)
