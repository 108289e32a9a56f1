"""The store: Parquet tables in segments, and one manifest that says which of them are current.

A table of norms is a set of segments, folders that are written once.  Which
segment has a norm's rows is a row (table, norm_urn, segment, rows) of the
manifest, so replacing a few norms writes their rows and the manifest, and no
other norm's.  Whole tables are folders too.  A commit writes whatever it
changes beside what is there, then the manifest, then one small file that names
it; that file appears by a single rename, so readers see all of a commit or
none of it, and a failure between any two steps leaves the former state.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import schema
from quarry.functions.text import norm_of
from quarry.operators.ordered import first_of, upsert
from quarry.operators.search import SENT_ROWS

#: Used only where the session runs in one process and names no shared folder, as in local tests.
LOCAL = "/tmp/checkpoints"
LIVE = T.StructType([T.StructField(n, T.StringType()) for n in ("table", "norm_urn", "segment")] + [T.StructField("rows", T.LongType())])
EMPTY = {"number": 0, "live": None, "whole": {}, "schemas": {}, "segments": {}, "norms": {}}
#: Tables whose segments are cut by another column than the norm.
CUT_BY = {"posting": "bucket"}
#: Files of such a segment that a task has open at a time; with more folders the rest is sorted first.
OPEN_FILES = 256


class Files:
    """The few file operations that a store needs, on whatever file system its folder is in."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.system = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.system.listStatus(at)] if self.system.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> None:
        """A file with this text, by one rename; an error if there is one."""
        beside = self.path(f"{name}.{uuid.uuid4().hex}.new")
        stream = self.system.create(beside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf)
        plain = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(self.system.makeQualified(beside), self.system.makeQualified(self.path(name)), plain)

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)


class Tables:
    """How the tables of one state are read."""

    spark: SparkSession
    root: str
    state: dict

    def exists(self, name: str) -> bool:
        return name in self.state["whole"] or name in self.state["segments"]

    def live(self, name: str) -> DataFrame:
        """(norm_urn, segment, rows) of a table's norms."""
        if not self.state["live"] or name not in self.state["segments"]:
            return self.spark.createDataFrame([], LIVE).select("norm_urn", "segment", "rows")
        return self.spark.read.schema(LIVE).parquet(f"{self.root}/{self.state['live']}").where(F.col("table") == name).select("norm_urn", "segment", "rows")

    def full(self, name: str) -> DataFrame:
        """A table with norm_urn, though its readers may not see that column."""
        if name in self.state["whole"]:
            return self.spark.read.schema(self._schema(name)).parquet(f"{self.root}/{self.state['whole'][name]}")
        if name not in self.state["segments"]:
            if name not in Store.KINDS:
                raise schema.QuarryError(f"no table {name}")
            kind = Store.KINDS[name]
            return self.spark.createDataFrame([], kind if name != "xref" else T.StructType([*kind.fields, T.StructField("norm_urn", T.StringType())]))
        segments = self.state["segments"][name]
        if not segments:
            return self.spark.createDataFrame([], self._schema(name))
        folders = [f"{self.root}/{name}/segment={s}" for s in sorted(segments)]
        own = self._schema(name)
        rows = self.spark.read.schema(T.StructType([*own.fields, T.StructField("segment", T.StringType())])).option("basePath", f"{self.root}/{name}").parquet(*folders)
        if sum(segments.values()) > self.state["norms"][name]:  # some norm of a segment is not current there
            live = self._live_rows(name)
            current = live.select(F.col("norm_urn").alias("_n"), F.col("segment").alias("_s"))
            current = F.broadcast(current) if self.state["norms"][name] <= SENT_ROWS else current
            rows = rows.join(current, F.col("norm_urn").eqNullSafe(F.col("_n")) & (F.col("segment") == F.col("_s")), "left_semi")
        return rows.select(*own.fieldNames())

    def read(self, name: str) -> DataFrame:
        """A table; a known one that was never written is empty, an unknown one is an error."""
        rows = self.full(name)
        return rows.select(*schema.XREF.fieldNames()) if name == "xref" else rows

    def count(self, name: str, norm: str | None = None) -> int:
        """Rows of a table, or of one norm in it; the manifest knows those of norms."""
        if name in self.state["whole"] or name not in self.state["segments"]:
            rows = self.full(name)
            return (rows if norm is None else rows.where(F.col("norm_urn") == norm)).count()
        live = self._live_rows(name)
        return (live if norm is None else live.where(F.col("norm_urn") == norm)).agg(F.sum("rows")).first()[0] or 0

    def _live_rows(self, name: str) -> DataFrame:
        return self.live(name)

    def _schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(self.state["schemas"][name])


class Store(Tables):
    """Tables under one folder.  Norm tables: provision, xref, chunk, posting, indexed; whole tables: norm, ingest_log."""

    KINDS = {"norm": schema.NORM, "provision": schema.PROVISION, "xref": schema.XREF, "ingest_log": schema.INGEST_LOG, "chunk": schema.CHUNK, "posting": schema.POSTING, "indexed": schema.INDEXED}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @staticmethod
    def scratch(spark: SparkSession) -> Store:
        """A new store in the folder that driver and executors share."""
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = named or LOCAL
        return Store(spark, f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}")

    @property
    def files(self) -> Files:
        return Files(self.spark, self.root)

    @property
    def state(self) -> dict:
        """The last commit's."""
        found = max((n for n in self.files.names(f"{self.root}/_commits") if n.endswith(".json") and n[:12].isdigit()), default=None)
        return json.loads(self.files.text(f"{self.root}/_commits/{found}")) if found else json.loads(json.dumps(EMPTY))

    @contextmanager
    def commit(self) -> Iterator[Commit]:
        """Changes of several tables that become visible together when the block ends, or not at all."""
        changes = Commit(self)
        yield changes
        changes.finish()

    def vacuum(self) -> list[str]:
        """Deletes what no state but the last needs, also what failed commits left; not while another commits or reads an older state."""
        state, gone = self.state, []
        kept = {state["live"], *state["whole"].values(), *(f"{t}/segment={s}" for t, found in state["segments"].items() for s in found)}
        for table in self.files.names(self.root):
            if table == "_commits":
                continue
            gone += [f"{table}/{n}" for n in self.files.names(f"{self.root}/{table}") if f"{table}/{n}" not in kept]
        gone += [f"_commits/{n}" for n in self.files.names(f"{self.root}/_commits") if n != f"{state['number']:012d}.json"]
        for name in gone:
            self.files.delete(f"{self.root}/{name}")
        return gone

    def compact(self, *names: str) -> None:
        """Writes tables of many segments as one."""
        with self.commit() as changes:
            for name in names:
                changes.replace(name, changes.full(name))

    # each a commit of its own

    def replace(self, name: str, rows: DataFrame, norms: DataFrame | None = None) -> None:
        with self.commit() as changes:
            changes.replace(name, rows, norms)

    def drop(self, name: str, norm: str) -> int:
        """Takes a norm out of a table; how many rows it had."""
        n = self.count(name, norm)
        if n:
            with self.commit() as changes:
                changes.replace(name, self.full(name).limit(0), self.spark.createDataFrame([(norm,)], "norm_urn string"))
        return n

    def rewrite(self, name: str, rows: DataFrame) -> None:
        with self.commit() as changes:
            changes.rewrite(name, rows)

    def put_norms(self, rows: DataFrame) -> None:
        with self.commit() as changes:
            changes.upsert("norm", rows, ["urn"])

    def put_provisions(self, rows: DataFrame, norms: DataFrame | None = None) -> None:
        with self.commit() as changes:
            changes.put_provisions(rows, norms)

    def drop_norm(self, norm: str) -> int:
        """Takes a norm's provisions and outgoing links away; links to it are open again."""
        n = self.count("provision", norm)
        self.put_provisions(self.full("provision").limit(0), self.spark.createDataFrame([(norm,)], "norm_urn string"))
        return n

    def put_links(self, rows: DataFrame) -> int:
        """Upsert by (origin, target, text), the later row wins; how many were sent."""
        with self.commit() as changes:
            changes.put_links(rows)
        return rows.count()

    def resolve_pending(self) -> int:
        """Links whose target is there by now; how many were found."""
        with self.commit() as changes:
            return changes.resolve_pending()

    def log(self, rows: DataFrame) -> None:
        with self.commit() as changes:
            changes.log(rows)

    def norms_indexed(self) -> DataFrame:
        return self.read("ingest_log").select("norm_urn", "source_sha256").orderBy("norm_urn")

    # ---- the index's record

    def open_index(self, model: str, dimension: int, recreate: bool = False) -> dict:
        """The record of the chunk table; another model or dimension is an error unless it is made anew."""
        meta = {"model": model, "dimension": dimension}
        if self.exists("chunk-record") and not recreate:
            found = json.loads(self.read("chunk-record").first()[0])
            if wrong := [k for k in meta if found.get(k) != meta[k]]:
                raise schema.IncompatibleIndex(f"index has other {', '.join(wrong)}: {found}")
            return found
        self.rewrite("chunk-record", self.spark.createDataFrame([(json.dumps(meta),)], "value string"))
        return meta

    def status(self) -> DataFrame:
        """(table, rows) of all that is there."""
        return self.spark.createDataFrame([(n, self.count(n)) for n in self.KINDS], "table string, rows long")


class Commit(Tables):
    """What one commit changes; it reads its own changes."""

    def __init__(self, store: Store):
        self.store, self.spark, self.root = store, store.spark, store.root
        self.state = store.state
        self.changed: dict[str, DataFrame] = {}

    def _live_rows(self, name: str) -> DataFrame:
        return self.changed.get(name, self.live(name))

    @contextmanager
    def _open_files(self, n: int) -> Iterator[None]:
        """Up to ``n`` folders are written at once by a task, which then need not sort its rows by folder; 0 changes nothing."""
        key = "spark.sql.maxConcurrentOutputFileWriters"
        before = self.spark.conf.get(key, None)
        if n:
            self.spark.conf.set(key, str(n))
        try:
            yield
        finally:
            if n:
                self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)

    def _written(self, rows: DataFrame, folder: str, *cut: str) -> None:
        """One job; nobody sees the folder before the commit is done."""
        (rows.write.partitionBy(*cut) if cut else rows.write).parquet(f"{self.root}/{folder}")

    def replace(self, name: str, rows: DataFrame, norms: DataFrame | None = None) -> None:
        """Rows of the norms in ``rows`` take the place of what those norms had; others stay.

        A norm of ``norms`` (norm_urn) without rows has none any more.
        """
        segment, cut = uuid.uuid4().hex, CUT_BY.get(name, "norm_urn")
        folder = f"{name}/segment={segment}"
        with self._open_files(OPEN_FILES if name in CUT_BY else 0):
            self._written(rows, folder, cut)
        fields = [f for f in rows.schema.fields if f.name != cut] + [rows.schema[cut]]
        own = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
        added = self.spark.read.schema(own).parquet(f"{self.root}/{folder}").groupBy("norm_urn").agg(F.count(F.lit(1)).alias("rows"))
        added = added.select("norm_urn", F.lit(segment).alias("segment"), "rows")
        gone = added.select(F.col("norm_urn").alias("_gone"))
        if norms is not None:
            gone = gone.unionByName(norms.select(F.col("norm_urn").alias("_gone")))
        kept = self._live_rows(name).join(gone.distinct(), F.col("norm_urn").eqNullSafe(F.col("_gone")), "left_anti")
        # written at once: what follows reads it again and again, and counts of it go into the state
        folder = f"_live/{name}-{segment}"
        self._written(kept.unionByName(added).coalesce(8), folder)
        live = self.spark.read.schema("norm_urn string, segment string, rows long").parquet(f"{self.root}/{folder}")
        self.changed[name] = live
        held = {r["segment"]: r["n"] for r in live.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each segment
        known = self.state["segments"].get(name, {})
        self.state["segments"][name] = {s: max(known.get(s, n), n) for s, n in held.items()}
        self.state["norms"][name] = sum(held.values())
        self.state["schemas"][name] = json.loads(own.json())

    def rewrite(self, name: str, rows: DataFrame) -> None:
        """A whole small table again."""
        folder = f"{name}/whole-{uuid.uuid4().hex}"
        self._written(rows, folder)
        self.state["whole"][name], self.state["schemas"][name] = folder, json.loads(rows.schema.json())

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        self.rewrite(name, upsert(self.read(name), rows, keys))

    def log(self, rows: DataFrame) -> None:
        self.upsert("ingest_log", rows, ["norm_urn"])

    def put_provisions(self, rows: DataFrame, norms: DataFrame | None = None) -> None:
        """Replaces whole trees; links of replaced norms go, links to what is gone are open again.

        Of the other norms only those are written that link to a replaced one.
        """
        own = rows.select("norm_urn")
        replaced = (own if norms is None else own.unionByName(norms.select("norm_urn"))).distinct()
        self.replace("provision", rows, replaced)
        kept = self.full("xref").join(replaced, "norm_urn", "left_anti")
        touched = kept.where(F.col("target_urn").isNotNull()).join(replaced.select(F.col("norm_urn").alias("_r")), norm_of(F.col("target_urn")) == F.col("_r"), "left_semi").select("norm_urn").distinct()
        links = kept.join(touched, "norm_urn", "left_semi")
        self._put_xref(resolve_links(links, self.read("provision")), replaced.unionByName(touched))

    def put_links(self, rows: DataFrame) -> None:
        sent = rows.withColumn("norm_urn", norm_of(F.col("origin_id")))
        before = self.full("xref").join(sent.select("norm_urn").distinct(), "norm_urn", "left_semi")
        self._put_xref(upsert(before, sent, ["origin_id", "target_urn", "original_text"]))

    def resolve_pending(self) -> int:
        links, ids = self.full("xref"), self.read("provision").select(F.col("id").alias("target_urn")).distinct()
        open_links = links.where(~F.col("resolved")).join(ids, "target_urn", "left_semi")
        if not (found := open_links.count()):
            return 0
        own = links.join(open_links.select("norm_urn").distinct(), "norm_urn", "left_semi")
        self._put_xref(resolve_links(own, self.read("provision")))
        return found

    def _put_xref(self, links: DataFrame, norms: DataFrame | None = None) -> None:
        self.replace("xref", links.select(*schema.XREF.fieldNames(), "norm_urn"), norms)

    def finish(self) -> None:
        """The manifest, then the file that names it.  Another commit since this one began is an error."""
        state = self.state
        if self.changed:
            others = [self.live(n).withColumn("table", F.lit(n)) for n in state["segments"] if n not in self.changed]
            parts = others + [rows.withColumn("table", F.lit(n)) for n, rows in self.changed.items()]
            every = parts[0]
            for part in parts[1:]:
                every = every.unionByName(part)
            folder = f"_live/{uuid.uuid4().hex}"
            self._written(every.select(*LIVE.fieldNames()).coalesce(8), folder)
            state["live"] = folder
        state["number"] += 1
        try:
            self.store.files.put_new(f"{self.root}/_commits/{state['number']:012d}.json", json.dumps(state))
        except Exception as error:
            if f"{state['number']:012d}.json" in self.store.files.names(f"{self.root}/_commits"):
                raise schema.Conflict("another commit was made meanwhile") from error
            raise


def resolve_links(links: DataFrame, provisions: DataFrame) -> DataFrame:
    """Links with target_id and resolved as the provisions say; other columns stay."""
    ids = provisions.select(F.col("id").alias("_id")).distinct()
    found = links.drop("target_id", "resolved").join(ids, F.col("target_urn") == F.col("_id"), "left")
    more = [c for c in links.columns if c not in schema.XREF.fieldNames()]
    return found.select("origin_id", "target_urn", F.col("_id").alias("target_id"), "original_text", F.col("_id").isNotNull().alias("resolved"), *more)


def latest(log: DataFrame) -> DataFrame:
    return first_of(log, ["norm_urn"], [F.desc("at")])
