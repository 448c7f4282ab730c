"""Shared storage for intermediate tables, and the check of a size before a broadcast."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_made: list[str] = []


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='proofmark-')}")
    return _own[0]


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only on a local master that has none, under a temporary one."""
    folder = f"{_base(spark)}/proofmark-{uuid.uuid4().hex}"
    _made.append(folder)
    return folder


def materialize(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    gc.collect()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store that Spark reads is one file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def commit_new(spark: SparkSession, path: str, data: bytes) -> bool:
    """Publish a small file under a name that is still free: written beside it, then renamed.  False if another writer was first.

    A rename that never replaces a file is one step on HDFS; on a mounted folder a hard link is.
    """
    java = spark._jvm.org.apache.hadoop.fs
    final = java.Path(path)
    beside = java.Path(final.getParent(), f".{uuid.uuid4().hex}")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        old, new = Path(beside.toUri().getPath()), Path(final.toUri().getPath())
        new.parent.mkdir(parents=True, exist_ok=True)
        old.write_bytes(data)
        try:
            os.link(old, new)
        except FileExistsError:
            return False
        finally:
            old.unlink()
        return True
    out = fs.create(beside)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    options = getattr(java, "Options$Rename")
    none = spark.sparkContext._gateway.new_array(options, 1)
    none[0] = options.NONE
    try:
        java.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, final, none)
    except Exception as e:
        fs.delete(beside, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def read_file(spark: SparkSession, path: str) -> bytes:
    """The bytes of a small file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """The sorted names in a folder, none if it is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables or folders that are read no more, and the shuffle files behind them."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for _ in range(2):  # shuffle files go once the driver has forgotten the plans that made them, and what those held
        gc.collect()
        spark._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete every folder made so far.  For callers that have read all results that depend on them."""
    remove(spark, *_made)
    _made.clear()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Folders made inside are deleted at the end, so results have to be written or read inside."""
    before = len(_made)
    try:
        yield
    finally:
        remove(spark, *_made[before:])
        del _made[before:]


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table of fewer splits than cores are dealt out; a larger table stays where it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def gather(rows: DataFrame) -> DataFrame:
    """Rows of many small files in fewer tasks: Spark deals out 32 files a task, of which 16 tasks are made one as long as every core has some."""
    context = rows.sparkSession.sparkContext
    n = rows.rdd.getNumPartitions()
    return rows.coalesce(max(4 * context.defaultParallelism, n // 16)) if n > 4 * context.defaultParallelism else rows


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, each computed once however often later steps read it.

    The optimizer writes a column that holds a Python function out again wherever it is read, with all that it was made of; it does not
    look into rows that a generator made.
    """
    names = list(columns)
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in columns], F.inline_outer(F.array(made)).alias(*names))


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size of a table, without running anything: of one just written, the size of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_bytes(spark: SparkSession) -> int:
    """Bytes up to which a side of a join is broadcast: the session's own bound (spark.sql.autoBroadcastJoinThreshold), as Spark reads it."""
    return max(0, spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its size is within the session's bound; otherwise the join shuffles.

    Best asked of a table just written.
    """
    return F.broadcast(df) if plan_bytes(df) <= broadcast_bytes(df.sparkSession) else df
