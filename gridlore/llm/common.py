"""What the operators share: tables in the shared folder, row identity, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset (local mode, tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="gridlore-"))


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/gridlore/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts lineage, survives lost executors and gives every later reader the same rows."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridlore_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that stash() wrote and that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_gridlore_path", None)
        if path:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that operators have written to the shared folder; results that still read them end with it, so write those first."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/gridlore")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: rows of two or three numbers up to which a table is broadcast: about 20 MB
BROADCAST_ROWS = 500_000
#: what a broadcast table may hold, written as JSON; in memory it takes some three times that
BROADCAST_BYTES = 16 << 20


def lean(df: DataFrame, label: str) -> DataFrame:
    """A written table, marked for broadcast if it has few rows and they are short; Spark shuffles any other."""
    held = stash(df, label)
    size = F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in held.columns)))))
    rows, taken = held.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(held) if rows <= BROADCAST_ROWS and taken <= BROADCAST_BYTES else held


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, as texts can be long; kernels cut them further by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def _give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        _give_back()  # the worker waits for other tasks, of this operator or the next

    return df.mapInArrow(run, schema)


def row_ids() -> Iterator[int]:
    """Numbers of the rows of this task, distinct over all tasks of a stage; stash() what uses them, so that they stay."""
    at = TaskContext.get().partitionId() << 40
    while True:
        yield at
        at += 1


def texts_only(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """The named columns alone, in order, whatever else the table has."""
    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *(F.col(f"`{c}`") for c in more))


def packed(docs: DataFrame) -> DataFrame:
    """_row (all columns of a row), _id and _hash (of the text): no name of a column can clash with one of an operator."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return rows.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def translate_lower(c):
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of rows that come sorted by long keys, one at a time, however batches cut them."""
    import numpy as np

    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(int(c[a]) for c in cols)
            if held and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)
