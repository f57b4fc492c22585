"""Durable intermediate tables in the folder that the cluster shares.

``spark.checkpoint.dir`` names that folder; where it is unset in a local session (tests, a laptop) a temporary folder
stands in and is entered in the session, so that every later call agrees on it. A cluster without it is an error: its
executors have no folder in common.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here and survives lost executors.

    Nothing reads its shuffles again, so they are removed at once and do not wait for the driver's garbage collection.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    for held in _HELD:
        held.append(out)
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is not broadcast: that would pass it through the driver, and Spark's guess at its size sees no exploded rows."""
    return df.hint("merge")


_HELD: list[list[DataFrame]] = []


@contextmanager
def only_result(before: DataFrame | None = None) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that stashes a result; on leaving, ``before`` and every other table stashed meanwhile are removed."""
    made: list[DataFrame] = []
    results: list[DataFrame] = []
    _HELD.append(made)

    def keep(df: DataFrame, name: str) -> DataFrame:
        results.append(stash(df, name))
        return results[-1]

    try:
        yield keep
    finally:
        _HELD.remove(made)
    kept = {r._stash_path for r in results}
    for table in (before, *made):
        if getattr(table, "_stash_path", None) not in kept:
            discard(table)


def discard(df: DataFrame | None) -> None:
    """Remove a stashed table that nothing reads any more."""
    path = getattr(df, "_stash_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


#: Rows and bytes of a batch that goes to a Python worker; long texts make smaller batches.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of this session's Python stages, so that a worker's memory does not depend on its texts' lengths.

    Batches are made when a result is read, so this holds for the session; every operator with a Python stage calls it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
