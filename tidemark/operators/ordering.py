"""Dense places in a global order, and order statistics, without sorting everything in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.files import stash


def dense_index(rows: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), name: str = "place", start: int = 0) -> DataFrame:
    """Add ``name``: the row's place in the order, within its group of ``by`` if there is one; places have no gap.

    Rows are sorted in ranges and written once, so that places are the same however often a task is run. A range gives
    one count for each group in it; places before the range are sums of those. Equal rows take neighbouring places.
    """
    columns = rows.columns
    ordered = rows.repartitionByRange(*[F.col(c) for c in by], *order).sortWithinPartitions(*by, *order)
    held = stash(ordered.select(*columns, F.monotonically_increasing_id().alias("at_")), "ranges")
    part, local = F.expr("shiftright(at_, 33)"), F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))
    placed = held.withColumns({"part_": part, "local_": local})
    counts = placed.groupBy("part_", *by).agg(F.count(F.lit(1)).alias("n_"), F.min("local_").alias("first_"))
    before = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("part_").alias("of_part_"), *[F.col(c).alias(f"of_{c}_") for c in by], "first_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_")
    )
    same = [F.col("part_") == F.col("of_part_"), *[F.col(c).eqNullSafe(F.col(f"of_{c}_")) for c in by]]
    return placed.join(offsets, same).select(*columns, (F.col("before_") + F.col("local_") - F.col("first_") + start).alias(name))


def exact_median(rows: DataFrame, value: Column, name: str = "median") -> DataFrame:
    """One row: the median of a value, the mean of the two middle ones of an even number; null without values.

    Equal values are counted before anything is shuffled, so a value that nearly all rows have is one row. The different
    values are sorted in ranges; counts run on within a range, and from range to range.
    """
    counts = rows.select(value.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    held = stash(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "counts")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = held.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("from_part"))
    total = held.agg(F.sum("n").alias("total"))
    placed = held.withColumn("in_part", before(Window.partitionBy("part").orderBy("v"))).join(parts, "part").crossJoin(F.broadcast(total))  # one row
    first = F.col("from_part") + F.col("in_part")
    holds = lambda place: (first <= place) & (place < first + F.col("n"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = placed.select(F.when(holds(low), F.col("v")).alias("low"), F.when(holds(high), F.col("v")).alias("high"))
    return middle.agg(((F.max("low") + F.max("high")) / 2).alias(name))


def epoch_place(place: Column, n: int, epoch: Column | int, seed: int = 42, rounds: int = 4) -> Column:
    """Where a place of 0 to ``n`` - 1 comes in an epoch: a permutation drawn by seed and epoch, without a sort.

    A Feistel network over pairs (place div b, place mod b) of a x b >= n, each round adding a hash of one half to the
    other. What lands beyond ``n`` goes through it again. Fewer than a places lie beyond, so a walk ends within a steps:
    64 are enough for every ``n`` below 4,096, and beyond that a walk of 64 has a chance of less than 64^-64.
    """
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    b = -(-max(n, 1) // a)
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch

    def turned(v: Column) -> Column:
        left, right = F.floor(v / F.lit(b)).cast("bigint"), F.pmod(v, F.lit(b))
        for k in range(rounds):
            if k % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), epoch, F.lit(k), left), F.lit(b)), F.lit(b))
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), epoch, F.lit(k), right), F.lit(a)), F.lit(a))
        return left * b + right

    first = turned(place.cast("bigint"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), first, lambda v, _: F.when(v < n, v).otherwise(turned(v)))
