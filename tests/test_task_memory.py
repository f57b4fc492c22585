"""What a task holds of the boundary samples: the columns that a query reads, sorted once."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalog
from tidemark.sources.fixtures import boundary_samples

SMALL = "/root/testdata/sf0.001"


def plan(frame, mode="simple"):
    return frame.sparkSession._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), mode)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_state_features_that_are_not_asked_for_are_not_shuffled(spark):
    told = plan(catalog.queries()["PRJ10"](spark, SMALL))
    assert "concat(" not in told and "l_linestatus" not in told and "l_tax" not in told


@pytest.mark.parametrize("name", ["PRJ10", "UNN1"])
def test_lines_are_sorted_once(spark, no_broadcast, name):
    told = plan(catalog.queries()[name](spark, SMALL))
    assert sum("Sort [" in x and "l_orderkey" in x for x in told.splitlines()) == 1
    assert told.count("Exchange") == 2  # lines and orders


def test_an_order_key_on_several_orders_multiplies_the_lines_places(spark, tmp_path):
    for name in ("orders", "lineitem"):
        frame = spark.read.parquet(f"{SMALL}/{name}.parquet")
        key = frame.columns[0]
        (frame.unionByName(frame.where(F.col(key) % 3 == 0)) if name == "orders" else frame).write.parquet(f"{tmp_path}/{name}.parquet")
    places = boundary_samples(spark, str(tmp_path)).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("boundary_index")).alias("at"))
    rows = places.collect()
    assert rows and all(r["at"] == list(range(r["n"])) for r in rows)


def test_problems_are_shuffled_once(spark, no_broadcast):
    from tidemark.operators.policy import _problems

    row = "struct<progress:double,generated:bigint,remaining:double,answer:boolean,boundary:array<double>,features:array<double>,marks:array<int>>"
    traces = spark.createDataFrame([], f"dataset string, problem_id bigint, action int, input_order bigint, token_count bigint, correctness double, text array<double>, rows array<{row}>")
    told = plan(_problems(traces, ["dataset", "problem_id"]))
    assert told.count("Exchange") == 1 and "SortAggregate" not in told


def test_slots_are_found_once_as_the_column_expressions_find_them(spark):
    import numpy as np

    from tidemark.functions import vectors as V
    from tidemark.operators import slots

    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 3)], None if k % 7 == 0 else float(k % 5), [None if k % 11 == 0 else 1.0, float(k)][: k % 3]) for k in range(300)]
    rows += [(300, None, 1.0, [1.0]), (301, [1.0, None, 2.0], 1.0, [4.0, None]), (302, [0.0, 0.0, 0.0], 2.0, None)]
    frame = spark.createDataFrame(rows, "k int, v array<double>, w double, d array<double>")
    centres = np.array([[1.0, 0.0, 0.0], [0.6, 0.8, 0.0], [1.0, 0.0, 0.0], [0.0, 0.6, -0.8]])
    got = slots._slot_sums(frame.select("v", "d", "w"), centres).groupBy("slot", "i").agg(*[F.sum(c).alias(c) for c in ("wp", "w", "p", "n")])
    each = frame.select(V.argmax(slots.similarities(F.col("v"), centres)).alias("slot"), "w", F.posexplode("d").alias("i", "p"))
    want = each.groupBy("slot", "i").agg(F.sum(F.col("w") * F.col("p")).alias("wp"), F.sum("w").alias("w"), F.sum("p").alias("p"), F.count(F.lit(1)).alias("n"))
    told = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert told(got) == told(want) and got.where("slot is null").count()


def test_only_scores_at_the_ends_are_paired(spark):
    import random

    from tidemark.operators import neighborhood as N

    rng = random.Random(5)
    kinds = [lambda: rng.uniform(-1, 1), lambda: float(rng.randrange(3)), lambda: 1e9 + rng.random() * 1e-7, lambda: rng.choice([0.0, 1e9, 1e9 + 2e-7, 1e9 + 1e-7]), lambda: 1.0, lambda: rng.choice([0.5, None, 2.0, -1.0])]
    rows = [(k, [kinds[k % len(kinds)]() for _ in range(20)]) for k in range(120)]
    frame = spark.createDataFrame([*rows, (None, [0.0, 1.0])], "k int, action_scores array<double>")
    want = []
    for k, s in rows:
        held = [x for x in s if x is not None]
        pairs = sorted((-(a - b), i, j) for i, a in enumerate(s) for j, b in enumerate(s) if a is not None and b is not None and a - b >= 0.12)[:6]
        want += [(k, i, j, -g / max(1e-6, max(held) - min(held))) for g, i, j in pairs]
    found = N.score_pairs(frame, ["k"])
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "Join" not in plan(found) and "Sort " not in plan(found)
