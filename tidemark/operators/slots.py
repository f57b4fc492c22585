"""Slot memory: k-means centres of text vectors, priors by slot, and their mixture for a query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.functions.text import let
from tidemark.sources.files import stash


def _moved(units: DataFrame, centres: np.ndarray) -> np.ndarray:
    """One k-means step over all rows: sums by nearest centre on the executors, so that only the means reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centres), np.zeros(len(centres))
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                near = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]).argmin(1)
                np.add.at(total, near, x)
                count += np.bincount(near, minlength=len(centres))
        met = np.flatnonzero(count)
        sums = pa.array(total[met].tolist(), type=pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(met, type=pa.int32()), pa.array(count[met]), sums], names=["slot", "n", "total"])

    parts = units.mapInArrow(run, "slot int, n double, total array<double>").select("slot", "n", F.posexplode("total").alias("i", "s"))
    out = centres.copy()
    for row in parts.groupBy("slot", "i").agg((F.sum("s") / F.sum("n")).alias("mean")).collect():
        out[row["slot"], row["i"]] = row["mean"]
    return out


def fit_centres(rows: DataFrame, vector: str, k: int = 8, seed: int = 42, sample_rows: int = 5000, order: str = "vec_id", steps: int = 25) -> np.ndarray:
    """Unit centres by k-means over all rows, until they move by less than 1e-5 on average.

    The first centres are random distinct rows among the ``sample_rows`` of the smallest id digests.
    """
    units = stash(rows.select(order, V.l2_normal(F.col(vector)).alias("v")), "units")  # read by each step
    sample = units.orderBy(F.xxhash64(order), order).limit(sample_rows).collect()
    centres = np.array([r["v"] for r in sorted(sample, key=lambda r: r[order])], dtype=np.float64)
    if len(centres) > k:
        centres = centres[np.random.default_rng(seed).choice(len(centres), k, replace=False)].copy()
        for _ in range(steps):
            moved = _moved(units.select("v"), centres)
            shift = np.abs(moved - centres).mean()
            centres = moved
            if shift < 1e-5:
                break
    return centres / np.maximum(1e-8, np.linalg.norm(centres, axis=1, keepdims=True))


def similarities(vector: Column, centres: np.ndarray) -> Column:
    """Cosine similarities to every centre: a constant in the expression, no join."""
    rows = _table([[float(x) for x in c] for c in centres])
    return let(V.l2_normal(vector), lambda unit: F.transform(rows, lambda c: V.dot(unit, c)))


def _table(rows: list[list[float]]) -> Column:
    """A constant table, parsed once from one literal."""
    text = ";".join(",".join(map(repr, r)) for r in rows)
    return F.transform(F.split(F.lit(text), ";"), lambda r: F.split(r, ",").cast("array<double>"))


def _nearest(vectors: pa.ListArray, centres: np.ndarray) -> np.ndarray:
    """The centre of the largest :func:`similarities`, the first one where equal; -1 where a vector or a number in it is missing."""
    n, dim = len(vectors), centres.shape[1]
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    whole = np.bincount(np.repeat(np.arange(n), np.maximum(size, 0)), ~vectors.flatten().is_null().to_numpy(zero_copy_only=False), minlength=n)
    good = (size == dim) & (whole == dim)
    x = flat[np.repeat(good, np.maximum(size, 0))].reshape(-1, dim)
    # summed place by place, as the column expressions do
    length, near = np.zeros(len(x)), np.zeros((len(x), len(centres)))
    for k in range(dim):
        length += x[:, k] * x[:, k]
    unit = x / np.maximum(np.sqrt(length), 1e-8)[:, None]
    for k in range(dim):
        near += unit[:, k, None] * centres[None, :, k]
    out = np.full(n, -1)
    out[good] = near.argmax(axis=1) if len(x) else -1
    return out


def _slot_sums(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``(slot, i, wp, w, p, n)`` of ``rows(v, d, w)``, added up by batch: sums over the rows nearest to a slot by place of ``d``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot, d = _nearest(b.column(0), centres), b.column(1)
            size = d.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            if not size.sum():
                continue
            owner = np.repeat(np.arange(b.num_rows), size)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            width = int(size.max())
            key = (slot[owner] + 1) * width + place
            listed = d.flatten()
            w, p = (c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in (b.column(2), listed))
            has_w, has_p = (c.is_valid().to_numpy(zero_copy_only=False) for c in (b.column(2), listed))
            w, has_w = w[owner], has_w[owner]
            met = np.flatnonzero(np.bincount(key))
            total = lambda values, has: pa.array(np.bincount(key[has], values[has], minlength=key.max() + 1)[met], mask=np.bincount(key[has], minlength=key.max() + 1)[met] == 0)  # noqa: E731, B023
            slots = pa.array(met // width - 1, type=pa.int32(), mask=met < width)
            yield pa.RecordBatch.from_arrays(
                [slots, pa.array(met % width, type=pa.int32()), total(w * p, has_w & has_p), total(w, has_w), total(p, has_p), pa.array(np.bincount(key)[met], type=pa.int64())],
                names=["slot", "i", "wp", "w", "p", "n"],
            )

    return rows.mapInArrow(run, "slot int, i int, wp double, w double, p double, n bigint")


def slot_priors(rows: DataFrame, vector: str, distribution: str, weight: str, centres: np.ndarray) -> DataFrame:
    """``(slot, prior)`` for every slot: weighted mean distribution of the rows nearest to it, as a softmax of itself.

    A slot without rows has the unweighted mean over all rows in its place. Without any rows there is no prior.
    """
    parts = _slot_sums(rows.select(F.col(vector).cast("array<double>").alias("v"), F.col(distribution).cast("array<double>").alias("d"), F.col(weight).cast("double").alias("w")), centres)
    sums = parts.groupBy("slot", "i").agg(*[F.sum(c).alias(c) for c in ("wp", "w", "p", "n")])
    # slots by places, whatever the rows: small tables from here on; written, as they are read twice
    sums = stash(sums, "slot-sums")
    overall = sums.groupBy("i").agg((F.sum("p") / F.sum("n")).alias("mean"))
    own = sums.select("slot", "i", (F.col("wp") / F.greatest(F.lit(1e-8), F.col("w"))).alias("own"))
    slots = rows.sparkSession.range(len(centres)).select(F.col("id").cast("int").alias("slot"))
    means = slots.crossJoin(F.broadcast(overall)).join(own, ["slot", "i"], "left").select("slot", "i", F.coalesce("own", "mean").alias("p"))
    gathered = means.groupBy("slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("p"))
    return gathered.select("slot", V.softmax(F.col("p")).alias("prior"))


def query_slots(vector: Column, centres: np.ndarray, priors: list[list[float]], temperature: float = 0.35) -> Column:
    """Mixture of the slots' priors by softmaxed similarity."""
    columns = _table([[p[i] for p in priors] for i in range(len(priors[0]))])
    weights = V.softmax(similarities(vector, centres), temperature)
    return let(weights, lambda w: F.transform(columns, lambda c: V.dot(w, c)))


def mlp_scores(rows: DataFrame, features: str, layers: list[tuple[np.ndarray, np.ndarray]], keep: list[str]) -> DataFrame:
    """Forward pass of linear layers with ReLU between them, in batches; the weights travel with the function."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            x = np.stack([np.asarray(v, dtype=np.float64) for v in frame[features]]) if len(frame) else np.zeros((0, layers[0][0].shape[0]))
            for k, (w, b) in enumerate(layers):
                x = x @ w + b
                if k < len(layers) - 1:
                    x = np.maximum(x, 0.0)
            yield pd.DataFrame({**{c: frame[c] for c in keep}, "logits": list(x)})

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.select(*keep, features).mapInPandas(run, f"{kept}, logits array<double>")
