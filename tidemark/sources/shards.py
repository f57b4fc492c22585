"""Shards bounded by bytes, in streams, with a manifest that tells a reader which of them to open."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tidemark.sources.files import stash

#: A task packs about this many shards, so at most one in this many is short because its task ends.
SHARDS_PER_TASK = 32
_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8}
_OWN = ("shard", "example", "bytes")


def byte_size(value: Column, kind: DataType) -> Column:
    """Bytes of a value: its numbers and texts, four for a length; a null is none."""
    if isinstance(kind, StringType | BinaryType):
        size = F.octet_length(value) + 4
    elif isinstance(kind, StructType):
        size = sum((byte_size(value[f.name], f.dataType) for f in kind), F.lit(0).cast("bigint"))
    elif isinstance(kind, ArrayType):
        width = _WIDTHS.get(kind.elementType.simpleString())
        each = F.size(value) * width if width else F.aggregate(value, F.lit(0).cast("bigint"), lambda n, v: n + byte_size(v, kind.elementType))
        size = each + 4
    else:
        size = F.when(value.isNotNull(), F.lit(_WIDTHS.get(kind.simpleString(), 16)))
    return F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint"))


def pack(sizes: np.ndarray, limit: int, filled: int = 0) -> tuple[np.ndarray, int]:
    """How many shards were begun before or with each row, and the bytes of the last one, begun with ``filled`` bytes.

    A row goes to the shard of the row before it if it fits there, else it begins another one.
    """
    ends = np.cumsum(sizes)
    begun = np.zeros(len(sizes), dtype=np.int64)
    base, at = -filled, int(np.searchsorted(ends, limit - filled, side="right"))
    while at < len(sizes):
        begun[at] = 1 if at or filled else 0
        base = int(ends[at - 1]) if at else 0
        at = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
    return np.cumsum(begun), int(ends[-1] - base) if len(sizes) else filled


def write_sized_shards(df: DataFrame, path: str, streams: Sequence[str], order: Sequence[str], limit: int) -> None:
    """Rows of each stream in order, in shards of ``limit`` bytes at most (or of one larger row), and their manifest.

    ``path/rows`` is Parquet by stream and shard, one file each, with every row's place in its shard (``example``), which
    pairs of examples refer to. ``path/manifest`` has a row for each shard: ``place`` in its stream (from 0), ``examples``
    and ``bytes``. An empty table gives an empty manifest. Columns named ``shard``, ``example`` or ``bytes`` are an error.
    """
    clash = [c for c in df.columns if c in _OWN]
    if clash:
        raise ValueError(f"columns {clash} are the shards' own")
    size = sum((byte_size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0).cast("bigint"))
    held = stash(df.withColumn("bytes", size), "sized")
    total = held.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    tasks = max(1, -(-total // (limit * SHARDS_PER_TASK)))
    ordered = held.repartitionByRange(tasks, *streams, *order).sortWithinPartitions(*streams, *order)
    names = held.columns
    keys, at = [names.index(c) for c in streams], names.index("bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, filled, example, stream = TaskContext.get().partitionId() << 32, 0, 0, None
        for b in batches:
            sizes = b.column(at).to_numpy()
            told = list(zip(*[b.column(k).to_pylist() for k in keys], strict=True)) if keys else [()] * b.num_rows
            starts = [k for k in range(b.num_rows) if k == 0 or told[k] != told[k - 1]]
            for lo, hi in zip(starts, [*starts[1:], b.num_rows], strict=True):
                if told[lo] != stream:
                    shard, filled, example, stream = shard + 1, 0, 0, told[lo]
                begun, filled = pack(sizes[lo:hi], limit, filled)
                new = np.diff(np.concatenate(([0], begun))) > 0
                places = np.arange(hi - lo)
                first = np.maximum.accumulate(np.where(new, places, -1))
                within = np.where(first >= 0, places - first, places + example)
                made = [pa.array(shard + begun), pa.array(within.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, *made], names=[*names, "shard", "example"])
                shard, example = shard + int(begun[-1]), int(within[-1]) + 1

    schema = StructType([*held.schema.fields, StructField("shard", LongType()), StructField("example", LongType())])
    ordered.mapInArrow(run, schema).write.mode("overwrite").partitionBy(*streams, "shard").parquet(f"{path}/rows")
    written = df.sparkSession.read.schema(schema).parquet(f"{path}/rows")
    counts = written.groupBy(*streams, "shard").agg(F.count(F.lit(1)).alias("examples"), F.sum("bytes").alias("bytes"))
    placed = counts.withColumn("place", F.row_number().over(Window.partitionBy(*streams).orderBy("shard")) - 1)
    placed.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")  # a row for each shard


def read_manifest(spark: SparkSession, path: str, **stream: object) -> DataFrame:
    """The shards of a stream, or of all."""
    rows = spark.read.parquet(f"{path}/manifest")
    for name, value in stream.items():
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    return rows


def read_sized_shards(spark: SparkSession, path: str, places: tuple[int, int] | None = None, **stream: object) -> DataFrame:
    """Rows of a stream, or of the shards from the first place to before the last one; files of other shards are not opened."""
    manifest = read_manifest(spark, path, **stream)
    rows = spark.read.parquet(f"{path}/rows")
    for name, value in stream.items():
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    if places is None:
        return rows
    wanted = manifest.where(F.col("place").between(places[0], places[1] - 1)).select("shard")
    return rows.join(wanted, "shard", "left_semi")


def stream_counts(spark: SparkSession, path: str, streams: Sequence[str]) -> DataFrame:
    """Shards, examples and bytes by stream, from the manifest alone."""
    return read_manifest(spark, path).groupBy(*streams).agg(F.count(F.lit(1)).alias("shards"), F.sum("examples").alias("examples"), F.sum("bytes").alias("bytes"))
