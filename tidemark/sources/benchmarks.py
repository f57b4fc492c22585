"""Benchmark items: keys, limits, lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordering import dense_index


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row by key: the last one in order."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def double_keyed(rows: DataFrame, prefix: str, first: str, second: str, order: str) -> DataFrame:
    """Items under two keys each; where keys meet, the later write wins (row order, then the second key)."""
    name = lambda c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    keyed = rows.select("*", F.posexplode(F.array(name(first), name(second))).alias("key_order", "key"))
    return keyed.groupBy("key").agg(F.max_by(F.struct(*rows.columns), F.struct(order, "key_order")).alias("r")).select("key", "r.*")


def limited(rows: DataFrame, by: str, order: str, specs: Mapping[str, tuple[int, int | None]], limit: Mapping[str, int] | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of each named group, in order; the smaller of two limits counts. All columns stay."""
    kept = rows.where(F.col(by).isin(*specs))
    wanted = F.lit(False)
    for name, (offset, most) in specs.items():
        caps = [x for x in (most, (limit or {}).get(name)) if x is not None]
        inside = (F.col("group") == name) & (F.col("place") >= offset)
        wanted = wanted | (inside & (F.col("place") < offset + min(caps)) if caps else inside)
    packed = kept.select(F.struct(*[kept[c] for c in kept.columns]).alias("row"), kept[by].alias("group"), kept[order].alias("order"))
    return dense_index(packed, ["order"], ["group"]).where(wanted).select("row.*")


def load_benchmark(spark: SparkSession, root: str, name: str, least: int = 0) -> DataFrame:
    """The rows of a benchmark kept as Parquet under ``root/name/split``.

    ``mbpp`` is its test split, or its train split if that has fewer than ``least`` rows; ``arc_challenge`` both together;
    ``gpqa_diamond`` its train split; the others their test split.
    """
    read = lambda split: spark.read.parquet(f"{root}/{name}/{split}")
    if name == "arc_challenge":
        return read("train").unionByName(read("test"))
    if name == "gpqa_diamond":
        return read("train")
    test = read("test")
    return read("train") if name == "mbpp" and test.limit(least).count() < least else test


def resolve_items(rows: DataFrame, items: DataFrame, row_id: str, item_id: str, prompt: str) -> DataFrame:
    """Item by id, else by prompt (the item of the smallest id where prompts repeat), else null; one row for each of ``rows``.

    Prompts meet by their length and two digests, so that long texts are not sorted or shuffled as keys.
    """
    digest = lambda c: F.struct(F.length(c).alias("n"), F.xxhash64(c).alias("x"), F.md5(c).alias("m"))
    by_id = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("by_id")).distinct()
    by_prompt = items.where(F.col(prompt).isNotNull()).groupBy(digest(prompt).alias("by_prompt")).agg(F.min(item_id).alias("b"))
    found = rows.withColumn("prompt_digest", digest(prompt)).join(by_id, F.col(row_id) == F.col("by_id"), "left")
    joined = found.join(by_prompt, F.col("prompt_digest") == F.col("by_prompt"), "left")
    return joined.withColumn(item_id, F.coalesce("by_id", "b")).drop("by_id", "b", "prompt_digest", "by_prompt")
