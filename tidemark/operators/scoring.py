"""Cost-adjusted scores of traces, statistics of problems, hard examples and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ordering import exact_median

PROBLEM = ("dataset", "problem_id")


def falsy_or(value: Column, default: object) -> Column:
    """``value``, or the default where it is null or zero (a real 0.0 counts as absent)."""
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))


def safe_std(std: Column, eps: float = 1e-9, fallback: float = 1.0) -> Column:
    """A population standard deviation, or the fallback where it is no larger than ``eps``."""
    return F.when(std <= eps, F.lit(fallback)).otherwise(std)


def token_stats(traces: DataFrame, keys: Sequence[str] = PROBLEM, eps: float = 1e-9) -> DataFrame:
    """Mean and guarded population standard deviation of tokens by problem."""
    return traces.groupBy(*keys).agg(
        F.avg("token_count").alias("mean_tokens"), safe_std(F.stddev_pop("token_count"), eps).alias("std_tokens")
    )


def score_traces(traces: DataFrame, lam: float = 0.2, keys: Sequence[str] = PROBLEM) -> DataFrame:
    """Add ``token_z`` and ``score = correctness - lam * token_z``: one window over the problem, no join."""
    over = Window.partitionBy(*keys)
    z = (F.col("token_count") - F.avg("token_count").over(over)) / safe_std(F.stddev_pop("token_count").over(over))
    return traces.withColumn("token_z", z).withColumn("score", F.col("correctness") - F.lit(lam) * F.col("token_z"))


def score_from_stats(traces: DataFrame, stats: DataFrame, lam: float, keys: Sequence[str] = PROBLEM) -> DataFrame:
    """Scores from statistics computed before, joined by problem."""
    return traces.join(stats, list(keys)).withColumn("score", F.col("correctness") - lam * (F.col("token_count") - F.col("mean_tokens")) / F.col("std_tokens"))


def problem_stats(traces: DataFrame, keys: Sequence[str] = PROBLEM) -> DataFrame:
    """Per problem: configurations tried and correct, token range of the correct ones, mean, deviation, difficulty."""
    right = F.col("correctness") > 0
    tried, correct = F.count(F.lit(1)), F.count(F.when(right, 1))
    return traces.groupBy(*keys).agg(
        tried.alias("n_configs_tried"), correct.alias("n_configs_correct"),
        F.min(F.when(right, F.col("token_count"))).alias("min_tokens_among_correct"),
        F.max(F.when(right, F.col("token_count"))).alias("max_tokens_among_correct"),
        F.avg("token_count").alias("mean_tokens_all_configs"),
        F.when(tried > 1, F.stddev_pop("token_count")).otherwise(F.lit(0.0)).alias("std_tokens_all_configs"),
        (1 - correct / F.greatest(tried, F.lit(1))).alias("difficulty_score"),
    )


def dataset_stats(traces: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Token statistics by dataset and, as ``__global__``, over all."""
    grouped = traces.rollup("dataset").agg(
        F.grouping("dataset").alias("all"), F.avg("token_count").alias("mean_tokens"), safe_std(F.stddev_pop("token_count"), eps).alias("std_tokens")
    )
    return grouped.select(F.when(F.col("all") == 1, F.lit("__global__")).otherwise(F.col("dataset")).alias("dataset"), "mean_tokens", "std_tokens")


def score_proxy(traces: DataFrame, stats: DataFrame, lam: float) -> DataFrame:
    """Score by dataset statistics; datasets without any take the global row."""
    own = stats.where("dataset <> '__global__'")
    world = stats.where("dataset = '__global__'").select(F.col("mean_tokens").alias("g_mean"), F.col("std_tokens").alias("g_std"))
    joined = traces.join(F.broadcast(own), "dataset", "left").crossJoin(F.broadcast(world))  # one row
    z = (F.col("token_count") - F.coalesce("mean_tokens", "g_mean")) / F.coalesce("std_tokens", "g_std")
    return joined.withColumn("score_proxy", F.col("correctness") - lam * z).drop("g_mean", "g_std", "mean_tokens", "std_tokens")


def hard_examples(scored: DataFrame, threshold: float = 1.0, keys: Sequence[str] = PROBLEM) -> DataFrame:
    """Problems without a correct trace, or with one of unusually many tokens; reasons in that order."""
    grouped = scored.groupBy(*keys).agg(
        F.every(F.col("correctness") <= 0).alias("wrong"), F.some(F.col("token_z") >= threshold).alias("costly"), F.count(F.lit(1)).alias("num_traces")
    )
    reasons = F.array_compact(F.array(F.when(F.col("wrong"), F.lit("all_incorrect")), F.when(F.col("costly"), F.lit("high_token_z"))))
    return grouped.where("wrong or costly").select(*keys, reasons.alias("reasons"), "num_traces")


def dataset_summary(traces: DataFrame) -> DataFrame:
    """Rows, mean correctness and mean tokens by dataset and, with a null dataset, over all."""
    return traces.rollup("dataset").agg(F.count(F.lit(1)).alias("n"), F.avg("correctness").alias("mean_correctness"), F.avg("token_count").alias("mean_tokens"))


def recover_lambda(scored: DataFrame) -> DataFrame:
    """One row: the median of ``(correctness - score) / token_z`` where the z-score is not near zero; else 0."""
    score = falsy_or(F.col("score"), None)
    usable = scored.where(F.abs("token_z") >= 1e-8)
    ratio = (F.col("correctness") - F.coalesce(score, F.col("correctness"))) / F.col("token_z")
    return exact_median(usable, ratio).select(F.coalesce("median", F.lit(0.0)).alias("lam"))


def best_action(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The action of the highest mean score, overall or in each group; ties go to the smaller action."""
    means = scored.groupBy(*by, "info_mode", "cot_mode").agg(F.avg("score").alias("mean_score"))
    order = [F.desc("mean_score"), F.asc("info_mode"), F.asc("cot_mode")]
    if not by:
        return means.orderBy(*order).limit(1)
    return means.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("rank = 1").drop("rank")


def oracle_action(scored: DataFrame, keys: Sequence[str] = PROBLEM) -> DataFrame:
    """The trace of the highest score by problem, the first one where equal: one aggregation, no sort."""
    row = F.struct("info_mode", "cot_mode", "score", "correctness", "token_count")
    best = scored.groupBy(*keys).agg(F.max_by(row, F.struct(F.col("score"), -F.col("input_order"))).alias("best"))
    return best.select(*keys, "best.*")


def context_tag(category: Column, registry_category: Column) -> Column:
    """``code`` or ``non_code``: the row's category counts first, then the registry's, in lower case."""
    said = F.lower(F.coalesce(F.nullif(category, F.lit("")), registry_category, F.lit("")))
    return F.when(said == "code", F.lit("code")).otherwise(F.lit("non_code"))


def dataset_category(dataset: Column, category: Column, registry_category: Column) -> Column:
    """The registry's category first, then the row's in lower case, else ``unknown``."""
    return F.coalesce(registry_category, F.nullif(F.lower(F.trim(category)), F.lit("")), F.lit("unknown"))


def action_index(info: Column, cot: Column, n_cot: int = 5) -> Column:
    """Dense index of an action, row by row of the grid; info modes count from 1."""
    return (info - 1) * n_cot + cot


def last_action_scores(scored: DataFrame, keys: Sequence[str] = PROBLEM) -> DataFrame:
    """One row by problem and action: the last trace in input order counts."""
    row = F.struct("score", "correctness", "token_count")
    last = scored.groupBy(*keys, "info_mode", "cot_mode").agg(F.max_by(row, "input_order").alias("r"))
    return last.select(*keys, "info_mode", "cot_mode", "r.*")
