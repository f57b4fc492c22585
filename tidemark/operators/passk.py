"""pass@1 and the unbiased pass@k estimator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pass_at_1(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("correctness").cast("bigint").alias("correct"), F.avg("correctness").alias("pass_at_1"))


def estimator(n: Column, c: Column, k: Column) -> Column:
    """``1 - C(n-c, k) / C(n, k)`` as a product; ``k`` is cut to ``n``; 1 if fewer than ``k`` are wrong."""
    kk = F.least(k, n)
    steps = F.sequence(n - c + 1, F.greatest(n, n - c + 1))
    product = F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * (1 - kk / i))
    return F.when(c == 0, F.lit(0.0)).when(n - c < kk, F.lit(1.0)).otherwise(1 - product)


def pass_at_k(rows: DataFrame, by: Sequence[str], problem: Sequence[str], ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Mean estimate over problems by group and ``k``."""
    each = rows.groupBy(*by, *problem).agg(F.count(F.lit(1)).alias("n"), F.sum("correctness").cast("bigint").alias("c"))
    spread = each.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return spread.withColumn("v", estimator(F.col("n"), F.col("c"), F.col("k"))).groupBy(*by, "k").agg(F.count(F.lit(1)).alias("num_problems"), F.avg("v").alias("pass_at_k"))
