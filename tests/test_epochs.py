"""The order of an epoch is a permutation for every size, and another one each epoch."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.ordering import epoch_place


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 97, 1000, 4097, 50_000])
def test_every_size_is_a_permutation(spark, n):
    rows = spark.range(n).select("id", *[epoch_place(F.col("id"), n, e).alias(f"e{e}") for e in range(2)]).collect()
    first, second = [r.e0 for r in rows], [r.e1 for r in rows]
    assert sorted(first) == sorted(second) == list(range(n))
    if n >= 97:
        assert first != second
        assert sum(p == k for k, p in enumerate(first)) < n / 10
        assert sum(abs(x - y) == 1 for x, y in zip(first, first[1:])) < n / 5


def test_seed_and_epoch_decide(spark):
    place = lambda **how: [r.p for r in spark.range(200).select(epoch_place(F.col("id"), 200, **how).alias("p")).collect()]
    assert place(epoch=1) == place(epoch=1) == place(epoch=F.lit(1)) != place(epoch=1, seed=7)
