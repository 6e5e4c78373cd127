"""Intermediate tables in the cluster's shared folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of narrow (a few numbers) data that are broadcast; beyond it, the join shuffles.
BROADCAST_ROWS = 200_000
#: The same for rows of a single number.
BROADCAST_KEYS = 1_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def folder(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; one of our own only where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: lineage ends, lost executors cost nothing.

    The shuffles of the write go from the executors' disks with it, since nothing reads them again; else they would
    stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a `table` that nothing reads any more."""
    path = _paths.pop(df, None)
    if path:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(session.sessionState().newHadoopConf()).delete(where, True)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast where its counted rows are few enough."""
    return F.broadcast(df) if rows <= most else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
