"""Deterministic splits of problems and items.

The hash modes order by a digest of seed and key, so they scale and repeat exactly. The exact mode draws with Python's
generator on the driver, for parity with splits made elsewhere; its keys must fit there.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import dense_index


def val_size(n: int, fraction: float) -> int:
    """Validation problems of ``n``: half to even, one at least, all but one at most; none of a single one."""
    return 0 if n <= 1 else min(n - 1, max(1, round(n * fraction)))


def hash_split(rows: DataFrame, keys: Sequence[str], seed: str, fraction: float) -> DataFrame:
    """``(keys, split)``: the problems of the smallest digests are ``val``.

    Problems take their places in the order of the digests range by range, so no task sorts or holds them all.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]))
    placed = dense_index(rows.select(*keys).distinct().withColumn("digest", digest), ["digest", *keys])
    size = val_size(placed.count(), fraction)
    return placed.select(*keys, F.when(F.col("place") < size, F.lit("val")).otherwise(F.lit("train")).alias("split"))


def exact_problem_split(keys: Sequence[tuple], seed: int, fraction: float) -> tuple[list[tuple], list[tuple]]:
    """Train and validation keys as a seeded shuffle of the sorted keys gives them."""
    ordered = sorted(set(keys))
    shuffled = list(ordered)
    random.Random(seed).shuffle(shuffled)
    held = set(shuffled[: val_size(len(shuffled), fraction)])
    return [k for k in ordered if k not in held], [k for k in ordered if k in held]


def exact_split(rows: DataFrame, by: str, key: str, seed: str, sizes: Mapping[str, int], strict: bool = False) -> DataFrame:
    """Parts of stated sizes in each group, by digest order; rows beyond them are left out.

    ``strict`` raises if a group is too small for its parts.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(by).cast("string"), F.col(key).cast("string")))
    packed = rows.select(F.struct(*[rows[c] for c in rows.columns]).alias("row"), rows[by].alias("group"), rows[key].alias("key"), digest.alias("digest"))
    ranked = dense_index(packed, ["digest", "key"], ["group"], start=1)
    if strict:
        short = ranked.groupBy("group").agg(F.max("place").alias("n")).where(F.col("n") < sum(sizes.values())).limit(1).collect()
        if short:
            raise ValueError(f"{by} {short[0][0]} has {short[0][1]} rows of {sum(sizes.values())}")
    out, end = F, 0
    for name, n in sizes.items():
        end += n
        out = out.when(F.col("place") <= end, F.lit(name))
    parts = ranked.where(F.col("place") <= end)
    return parts.select(*[F.col("row")[c].alias(c) for c in rows.columns if c != "split"], out.otherwise(None).alias("split"))
