"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session runs in one process and names no shared folder, as in local tests.
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints"
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_CHECKPOINT_DIR).rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; no two calls get the same one."""
    return f"{shared_dir(spark)}/quarry/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table cuts the lineage: a lost executor costs at most the
    tasks of the current stage, never a second run of what came before.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for table in tables:
        if path := _paths.pop(table, None):
            jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(session.sessionState().newHadoopConf()).delete(folder, True)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


#: Rows that a task turns into Python objects at a time.
SLICE_ROWS = 512


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of a single batch, which gets ``SLICE_ROWS`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                if (out := function(batch.slice(at, SLICE_ROWS))) is not None:
                    yield out
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def crc_fold(id_column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus`` (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(df: DataFrame, rows: int, keys: list[str], seed: int) -> DataFrame:
    """At most ``rows`` rows by a seeded hash of ``keys``, in its order.

    A threshold on the hash leaves about twice as many before they are ordered,
    so that tasks and driver never hold more than that in all.  Rows equal in
    ``keys`` have one mark; which of them are taken at the cut is open.
    """
    share = min(1.0, 2 * rows / max(1, df.count()))
    mark = F.xxhash64(F.lit(seed), *keys)
    return df.withColumn("_mark", mark).where(F.pmod("_mark", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("_mark", *keys).limit(rows).drop("_mark")


#: Rows that one window of a rank holds, on average, where a single key has them all.
WINDOW_ROWS = 1 << 16


def salts_for(rows: int) -> int:
    """Salts that keep the windows of ``rows`` rows of one key bounded."""
    return max(256, -(-rows // WINDOW_ROWS))


def salted_rank(df: DataFrame, keys: list[str], order: list[str], rank: str, salts: int = 256) -> DataFrame:
    """Number the rows of each key from 0 without bringing a key into one task.

    The order is by salt (a hash of the order columns), then by those columns
    within the salt, so it depends on the rows alone.  A key's rows are spread
    over ``salts`` windows; only counts by (key, salt) are summed up.  Which of
    rows that are equal in ``keys`` and ``order`` comes first is open.
    """
    from pyspark.sql import Window

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    numbered = salted.withColumn("_within", F.row_number().over(inner) - 1)
    on = [numbered[k].eqNullSafe(starts[k]) for k in [*keys, "_salt"]]
    joined = numbered.join(starts, on, "inner")
    return joined.select(*[numbered[c] for c in df.columns], (starts["_from"] + numbered["_within"]).alias(rank))


def merged_spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as sorted, disjoint, non-touching spans."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > end[:-1])))
    return begin[new], end[np.concatenate((new[1:] - 1, [len(end) - 1]))]
