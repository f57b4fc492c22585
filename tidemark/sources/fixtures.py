"""Trace-shaped views of the generic tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event as one static trace; ``input_order`` breaks ties."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("dataset"),
        F.col("user_id").cast("string").alias("problem_id"),
        (F.col("event_id") % 4 + 1).cast("int").alias("info_mode"),
        F.expr("cast((event_id div 4) % 5 as int)").alias("cot_mode"),
        F.when(F.col("value") > 20, F.lit(1.0)).otherwise(F.lit(0.0)).alias("correctness"),
        F.floor(F.col("value") * 10).cast("bigint").alias("token_count"),
        F.col("event_id").cast("bigint").alias("input_order"),
    )


TRACES = """traces as (
  select event_type as dataset, cast(user_id as varchar) as problem_id, cast(1 + event_id % 4 as integer) as info_mode,
    cast((event_id // 4) % 5 as integer) as cot_mode, cast(case when value > 20 then 1 else 0 end as double) as correctness,
    cast(floor(value * 10) as bigint) as token_count, cast(event_id as bigint) as input_order
  from events)"""

SCORED = TRACES + """, stats as (
  select dataset, problem_id, avg(token_count) as mean_tokens, case when stddev_pop(token_count) <= 1e-9 then 1.0 else stddev_pop(token_count) end as std_tokens
  from traces group by all
), scored as (
  select t.*, (token_count - mean_tokens) / std_tokens as token_z, correctness - 0.2 * ((token_count - mean_tokens) / std_tokens) as score
  from traces t join stats using (dataset, problem_id))"""


#: Features that are remainders of keys, as a share of the divisor.
_SHARES = (
    ("segment_progress_ratio", "l_suppkey", 17), ("top1_prob", "l_partkey", 29), ("top2_prob", "l_partkey", 23),
    ("topk_mass", "l_partkey", 31), ("eos_prob", "l_suppkey", 13), ("repeat_ngram_ratio", "l_partkey", 11),
)


def boundary_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line item as one decision boundary of the trace that its order stands for."""
    from pyspark.sql.window import Window

    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    same = Window.partitionBy("o_orderkey")
    # lines are numbered before the join, which leaves them as they are sorted: a task sorts its lines once, and as they are
    # stored; an order key that stands on several orders multiplies its lines' numbers
    lines = lines.withColumn("place", F.row_number().over(order) - 1)
    orders = orders.withColumn("copies", F.count(F.lit(1)).over(same)).withColumn("copy", F.row_number().over(same.orderBy("o_custkey", "o_orderpriority", "o_totalprice")) - 1)
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_orderpriority").alias("dataset"),
        F.col("o_custkey").cast("bigint").alias("problem_id"),
        F.col("o_orderkey").cast("bigint").alias("trace_id"),
        (F.col("place") * F.col("copies") + F.col("copy")).cast("int").alias("boundary_index"),
        (F.col("o_orderkey") % 4 + 1).cast("int").alias("chosen_info_mode"),
        F.expr("cast((o_orderkey div 4) % 5 as int)").alias("chosen_cot_mode"),
        (F.col("l_linenumber") / F.lit(7.0)).alias("progress_ratio"),
        (1 - F.col("l_linenumber") / F.lit(7.0)).alias("remaining_budget_ratio"),
        (F.col("l_discount") + F.lit(0.0)).cast("double").alias("entropy"),
        (F.col("l_tax") + F.lit(0.0)).cast("double").alias("margin"),
        F.col("l_quantity").cast("bigint").alias("generated_tokens"),
        F.col("l_returnflag").alias("boundary_kind"),
        (F.col("l_linestatus") == "F").alias("is_answer_zone"),
        (F.col("o_totalprice").cast("double") / F.lit(314159.0)).alias("score"),
        F.concat(F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey").cast("string")).alias("prompt"),
        *[(F.col(c) % n / F.lit(float(n))).alias(name) for name, c, n in _SHARES],
        (F.col("l_linenumber") * 3 % 7).cast("double").alias("eos_rank"),
        (F.col("l_linestatus") != "F").alias("is_in_think_zone"),
        (F.col("o_orderkey") % 3 == 0).alias("is_code_mode"),
    )


BOUNDARIES = f"""boundaries as (
  select o_orderpriority as dataset, cast(o_custkey as bigint) as problem_id, cast(o_orderkey as bigint) as trace_id,
    cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 as integer) as boundary_index,
    cast(o_orderkey % 4 + 1 as integer) as chosen_info_mode, cast((o_orderkey // 4) % 5 as integer) as chosen_cot_mode,
    l_linenumber / cast(7 as double) as progress_ratio, 1 - l_linenumber / cast(7 as double) as remaining_budget_ratio,
    cast(l_discount as double) + cast(0 as double) as entropy, cast(l_tax as double) + cast(0 as double) as margin,
    cast(l_quantity as bigint) as generated_tokens, l_returnflag as boundary_kind, l_linestatus = 'F' as is_answer_zone,
    cast(o_totalprice as double) / cast(314159 as double) as score, o_orderpriority || ' ' || o_orderkey as prompt,
    {', '.join(f'({c} % {n}) / cast({n} as double) as {name}' for name, c, n in _SHARES)},
    cast(l_linenumber * 3 % 7 as double) as eos_rank, l_linestatus <> 'F' as is_in_think_zone, o_orderkey % 3 = 0 as is_code_mode
  from lineitem join orders on l_orderkey = o_orderkey)"""
