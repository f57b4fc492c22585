"""Shards bounded by bytes, and training by shards."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import training
from tidemark.sources import shards

PAIRS = "array<struct<winner_index:int,loser_index:int,weight:double>>"


def next_fit(sizes, limit, filled):
    n, out = 0, []
    for s in sizes:
        if filled and filled + s > limit:
            n, filled = n + 1, 0
        filled += s
        out.append(n)
    return out, filled


def test_packing_is_next_fit():
    rng = random.Random(1)
    for _ in range(2000):
        sizes, limit, filled = [rng.randint(1, 30) for _ in range(rng.randint(1, 20))], rng.randint(5, 40), rng.choice([0, 0, 3, 50])
        got, left = shards.pack(np.array(sizes), limit, filled)
        assert (got.tolist(), left) == next_fit(sizes, limit, filled)


@pytest.mark.parametrize("limit", [200, 2000])
def test_shards_are_bounded_and_read_back(spark, limit):
    rng = random.Random(limit)
    rows = [(k, rng.choice(["train", "val", None]), rng.choice(["think", "answer"]), [0.5] * rng.choice([0, 1, 5, 60]), None if k % 9 == 0 else "é" * (k % 7)) for k in range(700)]
    frame = spark.createDataFrame(rows, "k bigint, split string, zone string, x array<double>, note string").repartition(5)
    path = f"{_folder(spark)}/sized-{limit}"
    shards.write_sized_shards(frame, path, ["split", "zone"], ["k"], limit)
    back = shards.read_sized_shards(spark, path)
    assert sorted((r.k, r.split, r.zone, r.x, r.note) for r in back.collect()) == sorted(rows)
    told = {(r.split, r.zone, r.shard): r for r in shards.read_manifest(spark, path).collect()}
    held = {}
    for r in back.orderBy("k").collect():
        held.setdefault((r.split, r.zone, r.shard), []).append(r)
    assert held.keys() == told.keys()
    for key, inside in held.items():
        want = [8 + 4 + 8 * len(r.x) + (0 if r.note is None else 4 + len(r.note.encode())) + 4 + len(r.zone) + (4 + len(r.split) if r.split else 0) for r in inside]
        assert [r.bytes for r in inside] == want and [r.example for r in inside] == list(range(len(inside)))
        assert told[key].bytes == sum(want) and told[key].examples == len(inside)
        assert sum(want) <= limit or len(inside) == 1
    places = sorted(r.place for r in told.values() if r.split == "train" and r.zone == "think")
    assert places == list(range(len(places)))
    part = shards.read_sized_shards(spark, path, (1, 3), split="train", zone="think")
    assert {r.shard for r in part.collect()} == {r.shard for r in told.values() if r.split == "train" and r.zone == "think" and r.place in (1, 2)}
    assert shards.read_sized_shards(spark, path, split="val").where("split <> 'val'").count() == 0


def test_empty_and_clashing(spark):
    path = f"{_folder(spark)}/sized-empty"
    frame = spark.createDataFrame([], "k bigint, s string")
    shards.write_sized_shards(frame, path, ["s"], ["k"], 100)
    assert shards.read_manifest(spark, path).count() == 0
    with pytest.raises(ValueError, match="bytes"):
        shards.write_sized_shards(frame.withColumn("bytes", F.lit(1)), path, ["s"], ["k"], 100)


def _folder(spark):
    from tidemark.sources.files import scratch

    return scratch(spark, "test")


@pytest.mark.parametrize("task_bytes", [2000, 1 << 30, 1])
def test_training_by_shards_matches_one_process(spark, task_bytes):
    rng = np.random.default_rng(3)
    n, sizes = 60, [5, 6, 3]
    x, w = rng.normal(size=(n, 5)), rng.uniform(0.5, 2, n)
    target = np.exp(x[:, :3])
    target /= target.sum(axis=1, keepdims=True)
    pairs = [[(0, 2, float(rng.uniform(0.5, 1)))] if k % 3 == 0 else [] for k in range(n)]
    shard = [None if k % 4 == 3 else 10 * (k % 4) for k in range(n)]
    frame = spark.createDataFrame([(x[k].tolist(), target[k].tolist(), float(w[k]), pairs[k], shard[k]) for k in range(n)], f"x array<double>, target array<double>, weight double, pairs {PAIRS}, shard int").repartition(3)
    start = training.new_network(sizes)
    epochs = 1 if task_bytes == 1 else 3
    made, told = training.train_by_shards(frame, start, pairs="pairs", epochs=epochs, lr=0.02, task_bytes=task_bytes)
    assert [sorted(s if s is not None else -1 for e, s, _ in told if e == k) for k in range(epochs)] == [[-1, 0, 10, 20]] * epochs
    flat = training._flat(start)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for step, (_, s, loss) in enumerate(told, 1):
        own = [k for k in range(n) if shard[k] == s]
        listed = np.array([(j, *p) for j, k in enumerate(own) for p in pairs[k]])
        g, want = training.gradients(training._shaped(flat, start), x[own], target[own], w[own] / w[own].sum(), listed * [1, 1, 1, 0.5 / listed[:, 3].sum()])
        assert abs(loss - want) < 1e-9
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat * (1 - 0.02 * 1e-4) - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(training._flat(made), flat, atol=1e-9)


def test_jobs_of_training_do_not_grow_with_the_shards(spark):
    rows = [([float(k % 7), 1.0], [1.0, 0.0], 1.0, k % 60) for k in range(240)]
    frame = spark.createDataFrame(rows, "x array<double>, target array<double>, weight double, shard int")
    spark.sparkContext.setJobGroup("shards", "training")
    try:
        _, told = training.train_by_shards(frame, training.new_network([2, 2]), epochs=2, task_bytes=1)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("shards"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(told) == 120 and jobs < 40


def test_training_without_rows_and_epoch_orders(spark):
    empty = spark.createDataFrame([], "x array<double>, target array<double>, weight double, shard int")
    start = training.new_network([2, 2])
    assert training.train_by_shards(empty, start) == (start, [])
    order = training.shard_order(spark, 40, 2)
    assert sorted(order[:40]) == sorted(order[40:]) == list(range(40)) and order[:40] != order[40:]
