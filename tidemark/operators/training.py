"""Training of the small scoring networks: gradients over all rows on the executors, AdamW steps on the driver.

``train_network`` makes one step an epoch, a pass over all rows: every partition adds up the gradients of its rows, and the
sums of the partitions are added up by parameter. What reaches the driver is one number for each parameter, whatever the
rows. ``train_by_shards`` makes one step for each shard, in an order drawn anew each epoch: the tasks of a barrier stage
each make the steps of a run of shards and hand the network on.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordering import epoch_place
from tidemark.sources.files import stash

Layers = list[tuple[np.ndarray, np.ndarray]]


def new_network(sizes: Sequence[int], seed: int = 42) -> Layers:
    """Linear layers with weights and biases drawn within one over the root of their inputs."""
    rng = np.random.default_rng(seed)
    return [(rng.uniform(-1, 1, (a, b)) / a**0.5, rng.uniform(-1, 1, b) / a**0.5) for a, b in zip(sizes, sizes[1:], strict=False)]


def _flat(layers: Layers) -> np.ndarray:
    return np.concatenate([p.ravel() for layer in layers for p in layer])


def _shaped(flat: np.ndarray, like: Layers) -> Layers:
    out, at = [], 0
    for w, b in like:
        out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


def forward(layers: Layers, x: np.ndarray) -> list[np.ndarray]:
    """The inputs of every layer and the logits; ReLU between layers."""
    held = [x]
    for k, (w, b) in enumerate(layers):
        x = x @ w + b
        if k < len(layers) - 1:
            x = np.maximum(x, 0.0)
        held.append(x)
    return held


def gradients(layers: Layers, x: np.ndarray, target: np.ndarray, weight: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, float]:
    """Flat gradient and loss of a sum over rows: ``weight`` times the soft cross-entropy, and over ``pairs`` ``(row, winner,
    loser, weight)`` of the weighted log(1 + exp(-margin)).
    """
    held = forward(layers, x)
    z = held[-1]
    shifted = z - z.max(axis=1, keepdims=True)
    log_p = shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))
    loss = float((-(target * log_p).sum(axis=1) * weight).sum())
    down = weight[:, None] * (target.sum(axis=1, keepdims=True) * np.exp(log_p) - target)
    if len(pairs):
        row, win, lose = (pairs[:, k].astype(np.int64) for k in range(3))
        margin = z[row, win] - z[row, lose]
        loss += float((pairs[:, 3] * np.logaddexp(0.0, -margin)).sum())
        pull = -pairs[:, 3] / (1.0 + np.exp(margin))
        np.add.at(down, (row, win), pull)
        np.add.at(down, (row, lose), -pull)
    out: Layers = []
    for k in range(len(layers) - 1, -1, -1):
        out.append((held[k].T @ down, down.sum(axis=0)))
        if k:
            down = (down @ layers[k][0].T) * (held[k] > 0)
    return _flat(out[::-1]), loss


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets, weights and pairs of a batch of ``(x, t, w, p)``."""
    x, target = (b.column(k).flatten().to_numpy().reshape(b.num_rows, -1) for k in (0, 1))
    listed, owner = b.column(3).flatten(), np.repeat(np.arange(b.num_rows), np.diff(b.column(3).offsets.to_numpy()))
    fields = [listed.field(k).to_numpy(zero_copy_only=False) for k in range(3)]
    return x, target, b.column(2).to_numpy(), np.column_stack((owner, *fields)).astype(np.float64)


def _step(rows: DataFrame, layers: Layers) -> tuple[np.ndarray, float]:
    """Gradient and loss over all rows ``(x, target, weight, pairs)``."""
    size = sum(w.size + b.size for w, b in layers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1)
        for b in batches:
            if b.num_rows:
                g, loss = gradients(layers, *_arrays(b))
                total[:-1] += g
                total[-1] += loss
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1), type=pa.int32()), pa.array(total)], names=["i", "v"])

    sums = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size + 1)
    for r in sums:
        out[r["i"]] = r["v"]
    return out[:-1], float(out[-1])


def train_network(
    rows: DataFrame, layers: Layers, features: str = "x", target: str = "target", weight: str = "weight", pairs: str | None = None,
    epochs: int = 40, lr: float = 3e-4, weight_decay: float = 1e-4, pairwise_weight: float = 0.5,
) -> tuple[Layers, list[float]]:
    """Layers after ``epochs`` AdamW steps on all rows, and the loss before each step.

    The loss is the mean of the soft cross-entropy, weighted relative to the mean weight, and ``pairwise_weight`` times the
    mean loss of the pairs (``array<struct<winner_index, loser_index, weight>>``), weighted likewise. Without rows the
    layers stay as they are.
    """
    held = stash(_examples(rows, features, target, weight, pairs), "examples")
    pair_sum = F.aggregate("p", F.lit(0.0), lambda acc, p: acc + p["weight"])
    n = held.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.size("p")).alias("np"), F.sum(pair_sum).alias("wp")).first()
    losses: list[float] = []
    if not n["n"]:
        return layers, losses
    # relative to the mean weight and over the count: both sums cancel to one factor
    own = 1.0 / max(1e-6 * n["n"], n["w"])
    of_pairs = pairwise_weight / max(1e-6 * n["np"], n["wp"]) if n["np"] else 0.0
    scaled = held.select("x", "t", (F.col("w") * own).alias("w"), F.transform("p", lambda p: F.struct(p["winner_index"], p["loser_index"], (p["weight"] * of_pairs).alias("weight"))).alias("p"))
    flat, losses = _steps(lambda flat, _: _step(scaled, _shaped(flat, layers)), _flat(layers), range(epochs), lr, weight_decay)
    return _shaped(flat, layers), losses


def _steps(sums: Callable[[np.ndarray, int], tuple[np.ndarray, float]], flat: np.ndarray, order: Sequence[int], lr: float, weight_decay: float) -> tuple[np.ndarray, list[float]]:
    """AdamW steps by gradient and loss of each entry of ``order``: parameters after the last, losses before each."""
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    losses = []
    for k, entry in enumerate(order, 1):
        g, loss = sums(flat, entry)
        losses.append(loss)
        flat, first, second = _adamw(flat, first, second, g, k, lr, weight_decay)
    return flat, losses


def _adamw(flat: np.ndarray, first: np.ndarray, second: np.ndarray, g: np.ndarray, k: int, lr: float, weight_decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters and moments after the ``k``-th step (from 1)."""
    first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
    return flat * (1 - lr * weight_decay) - lr * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8), first, second


def shard_order(spark: SparkSession, n: int, epochs: int, seed: int = 42) -> list[int]:
    """Places of ``n`` shards in the order in which ``epochs`` epochs visit them; as many numbers as there are steps."""
    if not n or not epochs:
        return []
    told = spark.range(n).select("id", *[epoch_place(F.col("id"), n, e, seed).alias(f"e{e}") for e in range(epochs)]).collect()
    visits = np.zeros((epochs, n), dtype=np.int64)
    for r in told:
        for e in range(epochs):
            visits[e, r[e + 1]] = r["id"]
    return visits.ravel().tolist()


def train_by_shards(
    rows: DataFrame, layers: Layers, shard: str = "shard", features: str = "x", target: str = "target", weight: str = "weight", pairs: str | None = None,
    epochs: int = 40, lr: float = 3e-4, weight_decay: float = 1e-4, pairwise_weight: float = 0.5, seed: int = 42, task_bytes: int = 256 << 20,
) -> tuple[Layers, list[tuple[int, int, float]]]:
    """Layers after an AdamW step for each shard in each epoch, and ``(epoch, shard, loss)`` before each step.

    The loss of a shard is that of :func:`train_network` over its rows alone. ``shard`` holds integers; a null is a shard of
    its own, the first one. An epoch is a barrier stage, which a lost executor starts again: its order of shards is cut into
    runs, one a task, of ``task_bytes`` each where the session has that many slots, and tasks take turns. Without rows the
    layers stay as they are.
    """
    spark = rows.sparkSession
    made = _examples(rows, features, target, weight, pairs, F.col(shard).cast("bigint").alias("shard"))
    held = stash(made, "examples")
    pair_sum = F.aggregate("p", F.lit(0.0), lambda acc, p: acc + p["weight"])
    by_shard = held.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w_sum"), F.sum(F.size("p")).alias("n_pairs"), F.sum(pair_sum).alias("p_sum"),
        F.sum(8 * (F.size("x") + F.size("t")) + 16 * F.size("p") + 8).alias("bytes"),
    )
    # a row for each shard; as many numbers reach the driver as an epoch has steps
    told = stash(by_shard.select(
        "shard", "bytes", (1.0 / F.greatest(1e-6 * F.col("n"), "w_sum")).alias("own"),
        F.when(F.col("n_pairs") > 0, pairwise_weight / F.greatest(1e-6 * F.col("n_pairs"), "p_sum")).otherwise(0.0).alias("of_pairs"),
    ), "shards")
    listed = told.select("shard", "bytes").orderBy(F.col("shard").asc_nulls_first()).collect()
    names = [r["shard"] for r in listed]
    order = shard_order(spark, len(names), epochs, seed)
    if not order:
        return layers, []
    number = F.coalesce(F.col("shard"), F.lit(-(2**63)))
    scaled = held.withColumnRenamed("shard", "of").join(told, F.col("of").eqNullSafe(F.col("shard"))).select(
        "x", "t", (F.col("w") * F.col("own")).alias("w"),
        F.transform("p", lambda p: F.struct(p["winner_index"], p["loser_index"], (p["weight"] * F.col("of_pairs")).alias("weight"))).alias("p"), number.alias("s"),
    )
    known = [-(2**63) if s is None else s for s in names]
    tasks = max(1, min(len(names), spark.sparkContext.defaultParallelism, -(-sum(r["bytes"] for r in listed) // task_bytes)))
    state, losses = np.concatenate((_flat(layers), np.zeros(2 * len(_flat(layers))))), []
    for e in range(epochs):
        steps = [(known[k], j) for j, k in enumerate(order[e * len(names) : (e + 1) * len(names)])]  # one for each shard
        state, told = _epoch(scaled, steps, layers, state, e * len(names), tasks, lr, weight_decay)
        losses += told
    return _shaped(np.split(state, 3)[0], layers), [(j // len(names), names[k], loss) for j, (k, loss) in enumerate(zip(order, losses, strict=True))]


def _epoch(scaled: DataFrame, steps: list[tuple[int, int]], layers: Layers, state: np.ndarray, before: int, tasks: int, lr: float, weight_decay: float) -> tuple[np.ndarray, list[float]]:
    """Parameters and moments after a step for each ``(shard, place)`` of an epoch, and the loss before each step.

    Each task has a run of the epoch's places, in order. Tasks take turns: one makes all its steps, with a shard in memory
    at a time, and hands the state to the next one. So an epoch exchanges as many states as there are tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        own, now, losses = context.partitionId(), state, []
        for turn in range(tasks):
            if turn == own:
                for place, parts in _by_place(batches):
                    flat, first, second = np.split(now, 3)
                    g, loss = map(sum, zip(*(gradients(_shaped(flat, layers), *part) for part in parts), strict=True))
                    losses.append((place, loss))
                    now = np.concatenate(_adamw(flat, first, second, g, before + place + 1, lr, weight_decay))
            if turn < tasks - 1:
                told = context.allGather(base64.b64encode(now.tobytes()).decode() if turn == own else "")
                now = np.frombuffer(base64.b64decode(told[turn]))
        values = [(-1 - i, v) for i, v in enumerate(now.tolist())] if own == tasks - 1 else []
        values += losses
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in values], type=pa.int64()), pa.array([v for _, v in values], type=pa.float64())], names=["i", "v"])

    places = scaled.sparkSession.createDataFrame(steps, "of bigint, place bigint")
    placed = scaled.join(F.broadcast(places), F.col("s") == F.col("of")).select("x", "t", "w", "p", "place")
    turn = F.expr(f"cast(place * {tasks} div {len(steps)} as int)")
    dealt = placed.repartitionById(tasks, turn).sortWithinPartitions("place")
    values = {r["i"]: r["v"] for r in dealt.mapInArrow(run, "i bigint, v double", barrier=True).collect()}
    return np.array([values[-1 - i] for i in range(len(state))]), [values[k] for k in range(len(steps))]


def _by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """The arrays of each place's rows, which come one after the other."""
    held, parts = None, []
    for b in batches:
        place = b.column(4).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if parts and held != int(place[lo]):
                yield held, parts
                parts = []
            held = int(place[lo])
            parts.append(_arrays(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(lo, hi - lo)]) for c in b.columns[:4]], names=["x", "t", "w", "p"])))
    if parts:
        yield held, parts


def _examples(rows: DataFrame, features: str, target: str, weight: str, pairs: str | None, *more: Column) -> DataFrame:
    """``x, t, w, p`` as doubles, and ``more``; rows without pairs have none."""
    none = F.expr("cast(array() as array<struct<winner_index:int,loser_index:int,weight:double>>)")
    listed = F.coalesce(F.transform(pairs, lambda p: F.struct(p["winner_index"].cast("int").alias("winner_index"), p["loser_index"].cast("int").alias("loser_index"), p["weight"].cast("double").alias("weight"))), none) if pairs else none
    doubles = lambda c: F.transform(c, lambda v: v.cast("double"))
    return rows.select(doubles(features).alias("x"), doubles(target).alias("t"), F.col(weight).cast("double").alias("w"), listed.alias("p"), *more)
