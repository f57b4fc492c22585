"""Embedding whitening by a two-pass covariance.

Entries become integers (256ths, rounded down), so the first pass is exact: counts and sums of the different vectors are
added up as Python integers. The second pass centres each vector on the exact mean before it multiplies: a task adds up
``C.T @ C`` of its batches, and ``treeAggregate`` merges one matrix a task. The driver holds one matrix, whose symmetric
eigenproblem LAPACK solves; the projection goes back to the tasks as a broadcast of that size. A third pass over the
different vectors measures the covariance of what came out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import small_batches, stash

SCALE = 256
COMPONENTS = 4


@dataclass
class Whitening:
    """What was fitted: ``n`` different vectors, their sums, the components (columns) and their eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(e); NaN for a component that the vectors don't spread over."""
        e = self.eigenvalues
        floor = max(float(e.max(initial=0.0)), 0.0) * len(self.sums) * np.finfo(float).eps
        return np.where(e > floor, 1 / np.sqrt(np.where(e > floor, e, 1.0)), np.nan)

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace if self.trace > 0 else np.full(len(self.eigenvalues), np.nan)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of packed 64-bit integers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(len(column), dims)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, x binary, dims int)``: each entry c as floor(256 c), packed; vectors with no or a broken entry are left out.

    What lies beyond 64 bits becomes the nearest 64-bit integer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            lists = lists.cast(pa.large_list(pa.float64())) if not pa.types.is_large_list(lists.type) else lists
            lengths = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # a null entry is not a number here
            rows = np.repeat(np.arange(len(lengths)), lengths)
            broken = np.bincount(rows, weights=~np.isfinite(flat), minlength=len(lengths)) > 0
            scaled = np.floor(SCALE * np.where(np.isfinite(flat), flat, 0.0))
            x = np.where(scaled >= 2.0**63, np.iinfo(np.int64).max, np.clip(scaled, -(2.0**63), 2.0**62 * 1.999).astype("<i8")).astype("<i8")
            data, ends = x.tobytes(), np.concatenate(([0], np.cumsum(lengths))) * 8
            keep = np.flatnonzero((lengths > 0) & ~broken)
            packed = pa.array([data[ends[k] : ends[k + 1]] for k in keep.tolist()], type=pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), packed, pa.array(lengths[keep], type=pa.int32())], names=["vec_id", "x", "dims"])

    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where("v is not null").mapInArrow(run, "vec_id bigint, x binary, dims int")


def _merged(parts: DataFrame, zero, read, add):
    """One value from one row a task, merged in a tree so that the driver gets few of them."""
    return parts.rdd.treeAggregate(zero, lambda held, row: add(held, read(row)), add, depth=2)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S/n`` in doubles: the integer part of the mean is taken off exactly, then the rest of it."""
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole, strict=True)])
    return _less(x, whole).astype(float) - rest


def _less(x: np.ndarray, whole: list[int]) -> np.ndarray:
    """Exact differences: 64-bit where they fit, else Python integers."""
    if max(map(abs, whole), default=0) < 1 << 61 and (not x.size or max(abs(int(x.min())), abs(int(x.max()))) < 1 << 61):
        return x - np.array(whole, dtype=np.int64)
    return x.astype(object) - np.array(whole, dtype=object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """For each row, the sum of ``(n x - S)^2`` as exact integers.

    With ``x = w + d`` and ``S = n w + r`` for the whole part ``w`` of the mean, it is n^2 sum(d^2) - 2 n sum(d r) + sum(r^2).
    """
    whole = [s // n for s in sums]
    r = [s - w * n for s, w in zip(sums, whole, strict=True)]
    d = _less(x, whole)
    most = max(abs(int(d.min())), abs(int(d.max())), *r, 1) if d.size else 1
    if d.dtype == object or most * most * len(sums) >= 1 << 62:
        d, right = d.astype(object), np.array(r, dtype=object)
    else:
        right = np.array(r, dtype=np.int64)
    squares, mixed, rest = (d * d).sum(axis=1).tolist(), (d * right).sum(axis=1).tolist(), sum(k * k for k in r)
    return [n * n * a - 2 * n * b + rest for a, b in zip(squares, mixed, strict=True)]


def fit(different: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """Fit on a table ``x binary`` that holds each different vector once."""
    size = min(components, dims)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0), dims)
            n += len(x)
            # halves of 32 bits add up without overflow
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + k for t, h, k in zip(total, high, low, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[str(n), *map(str, total)]])], names=["sums"])

    add_lists = lambda a, b: [i + j for i, j in zip(a, b, strict=True)]
    n, *total = _merged(different.select("x").mapInArrow(sums, "sums array<string>"), [0] * (dims + 1), lambda row: [*map(int, row[0])], add_lists)

    def outer(part) -> DataFrame:
        """One sum of ``part(C).T @ part(C)`` a task, over the centred vectors C."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for b in batches:
                if b.num_rows:
                    c = part(_centred(_matrix(b.column(0), dims), n, total))
                    held = c.T @ c if held is None else held + c.T @ c
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], type=pa.binary())], names=["sum"])

        return different.select("x").mapInArrow(run, "sum binary")

    def merged(part, k: int) -> np.ndarray:
        return _merged(outer(part), np.zeros((k, k)), lambda row: np.frombuffer(row[0]).reshape(k, k), np.add) / n

    covariance = merged(lambda c: c, dims)
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:size]
    out = Whitening(n, total, np.ascontiguousarray(vectors[:, order]), values[order], float(np.trace(covariance)))
    kept = np.flatnonzero(~np.isnan(out.scales))
    if kept.size:
        # the projected rows have mean zero up to rounding, as a projection of centred ones; its square is far below 1e-12
        project = out.components[:, kept] * out.scales[kept]
        found = merged(lambda c: c @ project, kept.size)
        out.identity_error = float(np.abs(found - np.eye(kept.size)).max())
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per vector: ``vec_id, n, deviation decimal(38,0), whitened, explained`` (arrays by component) and ``identity_error``.

    Vectors that are null or empty, or that hold a null or non-finite entry, are left out. The fit takes each different
    integer vector once, so copies don't count; they are reduced to one before they are shuffled. Repeated rows and rows
    without an id give a result row each. An eigenvalue that is zero within rounding (a single vector, equal entries, more
    dimensions than vectors) has ``whitened`` null; ``explained`` is null if there is no variance at all, and
    ``identity_error`` is then null as well. An empty table gives an empty result; vectors of different lengths raise
    ``ValueError``; a deviation of more than 38 digits is an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col)
    schema = "vec_id bigint, n bigint, deviation string, whitened array<double>, explained array<double>, identity_error double"
    different = stash(rows.select("x", "dims").distinct(), "different-vectors")
    lengths = [r["dims"] for r in different.select("dims").distinct().limit(9).collect()]
    if len(lengths) > 1:
        raise ValueError(f"vectors have one length; found {sorted(lengths)}")
    if not lengths:
        return spark.createDataFrame([], schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
    dims = lengths[0]
    fitted = spark.sparkContext.broadcast(fit(different, dims, components))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = fitted.value
        project, none = w.components * np.nan_to_num(w.scales), np.isnan(w.scales)
        lists = lambda m, mask: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), mask=np.broadcast_to(mask, m.shape).ravel()))
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), dims)
            white = _centred(x, w.n, w.sums) @ project
            share = np.broadcast_to(w.explained, white.shape)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([w.n] * len(x), type=pa.int64()), pa.array([*map(str, deviations(x, w.n, w.sums))]),
                    lists(white, none), lists(share, np.isnan(w.explained)), pa.array([w.identity_error] * len(x), type=pa.float64()),
                ],
                names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
