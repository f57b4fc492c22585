"""Boundaries of model inputs are shuffled once and as they are stored, and each meets the text of its own prompt."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalog
from tidemark.sources.fixtures import boundary_samples

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are not small
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_written_features_are_neither_shuffled_nor_sorted_and_lines_shuffled_once(spark, no_broadcast):
    rows = catalog.queries()["VEC8"](spark, SMALL)
    assert len(rows.collect()) == boundary_samples(spark, SMALL).count()
    final = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    moved = [line for line in final if " Exchange " in line or " Sort [" in line]
    assert moved and not any("trace_id" in line and "coalesce(prompt" in line for line in moved)
    dealt = [line for line in final if " Exchange hashpartitioning(l_orderkey" in line]
    assert sum("ReusedExchange" not in line for line in dealt) == 1


def test_a_boundary_meets_the_text_of_its_own_prompt(spark, tmp_path):
    lines, orders = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("lineitem", "orders"))
    key = F.col("o_orderkey") % 3
    again = orders.where(key == 0).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, F.lit("another")))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.unionByName(again).unionByName(orders.where(key == 1)).write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.queries()["VEC8"](spark, str(tmp_path)).select("trace_id", "boundary_index", F.substring_index("prior_x", ",", 16).alias("text")).collect()
    samples = boundary_samples(spark, str(tmp_path))
    from tidemark.functions import vectors as V
    from tidemark.plans.vector_queries import _r

    want = samples.select("trace_id", "boundary_index", _r(F.transform(V.hashed_vector(F.col("prompt"), 16), lambda v: v.cast("double")), 4).alias("text")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
