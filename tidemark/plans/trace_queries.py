"""Queries over traces and boundaries: scores, pairs, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.vectors import rounded
from tidemark.operators import pairs as P
from tidemark.operators import scoring as S
from tidemark.plans.registry import query
from tidemark.sources.fixtures import BOUNDARIES, SCORED, TRACES, boundary_samples, table, traces

KEY = ["dataset", "problem_id"]


def r(c: str, digits: int = 6):
    return rounded(c, digits).alias(c)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score_traces(traces(spark, sf_dir))


# --- windows and scores -------------------------------------------------------------------------------------------


@query("WIN1", f"with {SCORED} select dataset, problem_id, input_order, round(token_z, 6) as token_z, round(score, 6) as score from scored")
def win1(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEY, "input_order", r("token_z"), r("score"))


@query("JN1", f"with {SCORED} select dataset, problem_id, input_order, round(score, 6) as score from scored")
def jn1(spark, sf_dir):
    t = traces(spark, sf_dir)
    return S.score_from_stats(t, S.token_stats(t), 0.2).select(*KEY, "input_order", r("score"))


@query("WIN2", f"with {SCORED} select dataset, problem_id, input_order, cast(row_number() over (partition by dataset, problem_id order by round(score, 6) desc, input_order) as integer) as rank from scored")
def win2(spark, sf_dir):
    order = Window.partitionBy(*KEY).orderBy(rounded("score", 6).desc(), "input_order")
    return scored(spark, sf_dir).select(*KEY, "input_order", F.row_number().over(order).alias("rank"))


_PAIRS = """, ranked as (
  select {keys}, {carry}, score, row_number() over (partition by {keys} order by score desc, {order}) as rk,
    max(score) over (partition by {keys}) - min(score) over (partition by {keys}) as spread
  from {rows}
), joined as (
  select {sel}, w.rk as wr, l.rk as lr, w.score - l.score as gap, (w.score - l.score) / greatest(1e-6, w.spread) as weight
  from ranked w join ranked l using ({keys}) where w.rk < l.rk and w.score - l.score >= {gap}
), placed as (select *, row_number() over (partition by {keys} order by gap desc, wr, lr) as place from joined)
"""


def _scored9(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("score", rounded("score", 6))


_S9 = SCORED + ", s9 as (select * replace (round(score, 6) as score) from scored)"
_TP = _PAIRS.format(keys="dataset, problem_id", carry="input_order, info_mode, cot_mode", order="input_order", rows="s9", gap="0.2", sel="dataset, problem_id, w.input_order as winner_input_order, l.input_order as loser_input_order, w.info_mode as winner_info_mode, w.cot_mode as winner_cot_mode, l.info_mode as loser_info_mode, l.cot_mode as loser_cot_mode")
_TP_COLS = "dataset, problem_id, winner_input_order, loser_input_order, winner_info_mode, winner_cot_mode, loser_info_mode, loser_cot_mode, round(gap, 6) as score_gap, round(weight, 6) as pair_weight"


def _trace_pairs(spark, sf_dir, **how):
    out = P.preference_pairs(_scored9(spark, sf_dir), KEY, ["input_order"], ["input_order", "info_mode", "cot_mode"], **how)
    sides = [f"{s}_{c}" for s in ("winner", "loser") for c in ("input_order", "info_mode", "cot_mode")]
    return out.select(*KEY, *sides, r("score_gap"), r("pair_weight"))


@query("JN2", f"with {_S9}{_TP} select {_TP_COLS} from placed")
def jn2(spark, sf_dir):
    return _trace_pairs(spark, sf_dir, max_pairs=1_000_000)


@query("TOP1", f"with {_S9}{_TP} select {_TP_COLS} from placed where place <= 4")
def top1(spark, sf_dir):
    return _trace_pairs(spark, sf_dir)


@query("TOP1_best_vs_worst", f"with {_S9}{_TP} select {_TP_COLS} from placed where place <= 1")
def top1_best(spark, sf_dir):
    return _trace_pairs(spark, sf_dir, strategy="best_vs_worst")


@query("FLT2", f"with {_S9}{_TP} select count(*) as n_pairs, round(min(gap), 6) as smallest_gap from placed")
def flt2(spark, sf_dir):
    return _trace_pairs(spark, sf_dir, max_pairs=1_000_000).agg(F.count(F.lit(1)).alias("n_pairs"), rounded(F.min("score_gap"), 6).alias("smallest_gap"))


@query("WIN3", f"with {SCORED} select dataset, problem_id, input_order, round(max(score) over (partition by dataset, problem_id) - min(score) over (partition by dataset, problem_id), 6) as spread from scored")
def win3(spark, sf_dir):
    over = Window.partitionBy(*KEY)
    return scored(spark, sf_dir).select(*KEY, "input_order", rounded(F.max("score").over(over) - F.min("score").over(over), 6).alias("spread"))


_BP = _PAIRS.format(keys="dataset, problem_id, boundary_index", carry="trace_id", order="trace_id", rows="b9", gap="0.2", sel="dataset, problem_id, boundary_index, w.trace_id as winner_trace_id, l.trace_id as loser_trace_id")
_B9 = BOUNDARIES + ", b9 as (select * replace (round(score, 6) as score) from boundaries)"
_BP_COLS = "dataset, problem_id, boundary_index, winner_trace_id, loser_trace_id, cast(winner_trace_id as varchar) || '#' || cast(boundary_index as varchar) as winner_boundary_id, cast(loser_trace_id as varchar) || '#' || cast(boundary_index as varchar) as loser_boundary_id, round(gap, 6) as score_gap, round(weight, 6) as pair_weight"


def _boundary_pairs(spark, sf_dir, **how):
    b = boundary_samples(spark, sf_dir).withColumn("score", rounded("score", 6))
    keys = [*KEY, "boundary_index"]
    out = P.preference_pairs(b, keys, ["trace_id"], ["trace_id"], **how)
    name = lambda s: F.concat_ws("#", F.col(f"{s}_trace_id").cast("string"), F.col("boundary_index").cast("string")).alias(f"{s}_boundary_id")
    return out.select(*keys, "winner_trace_id", "loser_trace_id", name("winner"), name("loser"), r("score_gap"), r("pair_weight"))


@query("JN3", f"with {_B9}{_BP} select {_BP_COLS} from placed")
def jn3(spark, sf_dir):
    return _boundary_pairs(spark, sf_dir, max_pairs=1_000_000)


@query("TOP2", f"with {_B9}{_BP} select {_BP_COLS} from placed where place <= 4")
def top2(spark, sf_dir):
    return _boundary_pairs(spark, sf_dir)


# --- aggregates ----------------------------------------------------------------------------------------------------


@query("AGG1", f"with {SCORED} select dataset, problem_id, round(mean_tokens, 6) as mean_tokens, round(std_tokens, 6) as std_tokens from stats")
def agg1(spark, sf_dir):
    return S.token_stats(traces(spark, sf_dir)).select(*KEY, r("mean_tokens"), r("std_tokens"))


@query("AGG2", f"""with {TRACES} select dataset, problem_id, count(*) as n_configs_tried, count(*) filter (correctness > 0) as n_configs_correct,
  min(token_count) filter (correctness > 0) as min_tokens_among_correct, max(token_count) filter (correctness > 0) as max_tokens_among_correct,
  round(avg(token_count), 6) as mean_tokens_all_configs, round(case when count(*) > 1 then stddev_pop(token_count) else 0 end, 6) as std_tokens_all_configs,
  round(1 - cast(count(*) filter (correctness > 0) as double) / count(*), 6) as difficulty_score from traces group by all""")
def agg2(spark, sf_dir):
    out = S.problem_stats(traces(spark, sf_dir))
    return out.withColumns({c: rounded(c, 6) for c in ("mean_tokens_all_configs", "std_tokens_all_configs", "difficulty_score")})


@query("AGG3", f"with {TRACES} select dataset, problem_id, round(avg(token_count), 4) as mean_tokens, round(case when stddev_pop(token_count) <= 1e-6 then 1 else stddev_pop(token_count) end, 4) as std_tokens from traces group by all")
def agg3(spark, sf_dir):
    return S.token_stats(traces(spark, sf_dir), eps=1e-6).select(*KEY, r("mean_tokens", 4), r("std_tokens", 4))


@query("AGG4", f"""with {TRACES} select coalesce(dataset, '__global__') as dataset, round(avg(token_count), 6) as mean_tokens, round(stddev_pop(token_count), 6) as std_tokens
  from traces group by grouping sets ((dataset), ())""")
def agg4(spark, sf_dir):
    return S.dataset_stats(traces(spark, sf_dir)).select("dataset", r("mean_tokens"), r("std_tokens"))


@query("AGG5", f"""with {SCORED} select dataset, problem_id, array_to_string(list_filter([case when bool_and(correctness <= 0) then 'all_incorrect' end, case when bool_or(round(token_z, 9) >= 1.0) then 'high_token_z' end], lambda x: x is not null), ',') as reasons,
  count(*) as num_traces from scored group by dataset, problem_id having bool_and(correctness <= 0) or bool_or(round(token_z, 9) >= 1.0)""")
def agg5(spark, sf_dir):
    out = S.hard_examples(scored(spark, sf_dir).withColumn("token_z", rounded("token_z", 9)))
    return out.select(*KEY, F.array_join("reasons", ",").alias("reasons"), "num_traces")


@query("AGG6", f"with {TRACES} select dataset, count(*) as n, round(avg(correctness), 6) as mean_correctness, round(avg(token_count), 6) as mean_tokens from traces group by rollup (dataset)")
def agg6(spark, sf_dir):
    return S.dataset_summary(traces(spark, sf_dir)).select("dataset", "n", r("mean_correctness"), r("mean_tokens"))


@query("AGG7", f"with {SCORED} select round(coalesce(median((correctness - case when score = 0 then correctness else score end) / token_z), 0), 6) as lam from scored where abs(token_z) >= 1e-8")
def agg7(spark, sf_dir):
    return S.recover_lambda(scored(spark, sf_dir)).select(r("lam"))


@query("AGG8", f"with {SCORED} select info_mode, cot_mode, round(avg(score), 6) as mean_score from scored group by all order by avg(score) desc, 1, 2 limit 1")
def agg8(spark, sf_dir):
    return S.best_action(scored(spark, sf_dir)).select("info_mode", "cot_mode", r("mean_score"))


@query("AGG9", f"""with {SCORED}, m as (select dataset, info_mode, cot_mode, avg(score) as mean_score from scored group by all)
  select dataset, info_mode, cot_mode, round(mean_score, 6) as mean_score from m qualify row_number() over (partition by dataset order by mean_score desc, info_mode, cot_mode) = 1""")
def agg9(spark, sf_dir):
    return S.best_action(scored(spark, sf_dir), ["dataset"]).select("dataset", "info_mode", "cot_mode", r("mean_score"))


@query("AGG10", f"""with {SCORED} select dataset, problem_id, info_mode, cot_mode, round(score, 6) as score, correctness, token_count from scored
  qualify row_number() over (partition by dataset, problem_id order by round(score, 6) desc, input_order) = 1""")
def agg10(spark, sf_dir):
    out = S.oracle_action(_scored9(spark, sf_dir))
    return out.select(*KEY, "info_mode", "cot_mode", r("score"), "correctness", "token_count")


@query("AGG11", f"with {SCORED} select info_mode, count(*) as n, round(avg(correctness), 6) as mean_correctness, round(avg(score), 6) as mean_score, round(avg(token_count), 6) as mean_tokens from scored group by info_mode")
def agg11(spark, sf_dir):
    from tidemark.operators.replay import policy_summary

    return policy_summary(scored(spark, sf_dir), "info_mode").select("info_mode", "n", r("mean_correctness"), r("mean_score"), r("mean_tokens"))


_ACTION = f"{SCORED}, last as (select * from scored qualify row_number() over (partition by dataset, problem_id, info_mode, cot_mode order by input_order desc) = 1), best as (select info_mode as bi, cot_mode as bc from scored group by all order by avg(score) desc, 1, 2 limit 1)"
_POLICIES = f"""{_ACTION}, policies as (
  select dataset, problem_id, max(round(score, 6)) filter (info_mode = bi and cot_mode = bc) as static_score, arg_max(correctness, (round(score, 6), -input_order)) as oracle_correctness, max(round(score, 6)) as oracle_score,
    arg_max(round(score, 6), (-cot_mode, -info_mode)) as prior_score
  from last, best group by dataset, problem_id)"""


@query("JN11", f"with {_POLICIES} select dataset, problem_id, round(static_score, 6) as static_score, round(prior_score, 6) as prior_score, round(oracle_score, 6) as oracle_score from policies")
def jn11(spark, sf_dir):
    from tidemark.operators.replay import compare_policies

    return compare_policies(_scored9(spark, sf_dir)).select(*KEY, r("static_score"), r("prior_score"), r("oracle_score"))


@query("AGG12", f"with {_POLICIES} select count(*) as n, round(avg(prior_score - static_score), 6) as mean_delta, round(avg(cast(prior_score > static_score as integer)), 6) as win_rate, round(avg(oracle_score - prior_score), 6) as oracle_regret from policies where static_score is not null")
def agg12(spark, sf_dir):
    from tidemark.operators.replay import compare_policies, paired_comparison

    return paired_comparison(compare_policies(_scored9(spark, sf_dir)), "prior_score", "static_score", "oracle_score").select("n", r("mean_delta"), r("win_rate"), r("oracle_regret"))


@query("AGG13", f"with {TRACES} select dataset, info_mode, count(*) as n, cast(sum(correctness) as bigint) as correct, round(avg(correctness), 6) as pass_at_1 from traces group by all")
def agg13(spark, sf_dir):
    from tidemark.operators.passk import pass_at_1

    return pass_at_1(traces(spark, sf_dir), ["dataset", "info_mode"]).select("dataset", "info_mode", "n", "correct", r("pass_at_1"))


@query("AGG14", f"""with {TRACES}, p as (select dataset, problem_id, count(*) as n, cast(sum(correctness) as bigint) as c from traces group by all),
  e as (select p.*, ks.k, least(ks.k, n) as kk from p, (select unnest([1, 3, 5, 10]) as k) ks),
  f as (select dataset, k, case when c = 0 then 0 when n - c < kk then 1 else 1 - list_reduce(list_prepend(cast(1 as double), list_transform(range(n - c + 1, n + 1), lambda i: 1 - cast(kk as double) / i)), lambda a, b: a * b) end as v from e)
  select dataset, cast(k as integer) as k, count(*) as num_problems, round(avg(v), 6) as pass_at_k from f group by all""")
def agg14(spark, sf_dir):
    from tidemark.operators.passk import pass_at_k

    return pass_at_k(traces(spark, sf_dir), ["dataset"], ["problem_id"]).select("dataset", "k", "num_problems", r("pass_at_k"))


@query("AGG23", f"with {TRACES} select count(*) as n_traces, count(distinct (dataset, problem_id)) as n_problems, count(distinct (info_mode, cot_mode)) as n_actions from traces")
def agg23(spark, sf_dir):
    t = traces(spark, sf_dir)
    return t.agg(F.count(F.lit(1)).alias("n_traces"), F.countDistinct("dataset", "problem_id").alias("n_problems"), F.countDistinct("info_mode", "cot_mode").alias("n_actions"))


# --- projections ---------------------------------------------------------------------------------------------------


@query("PRJ2", "select event_id, coalesce(case when value < 20 then cast(floor(value) as bigint) end, case when event_id % 3 = 0 then user_id end, case when event_id % 3 = 1 then event_id end, 7) as token_count from events")
def prj2(spark, sf_dir):
    from tidemark.operators.projections import token_count

    e = table(spark, sf_dir, "events").withColumn("token_count", F.when(F.col("value") < 20, F.floor("value").cast("bigint")))
    usage = F.struct(F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("bigint")).alias("completion_tokens"), F.when(F.col("event_id") % 3 == 1, F.col("event_id").cast("bigint")).alias("output_tokens"), F.lit(7).cast("bigint").alias("total_tokens"))
    return e.withColumn("usage", usage).select("event_id", token_count("token_count", "usage").alias("token_count"))


@query("PRJ3", f"with {TRACES} select input_order, dataset || '_' || problem_id || '_i' || info_mode || '_c' || cot_mode || '_' || input_order as trace_id from traces")
def prj3(spark, sf_dir):
    from tidemark.operators.projections import trace_id

    return traces(spark, sf_dir).select("input_order", trace_id("dataset", "problem_id", "info_mode", "cot_mode", "input_order").alias("trace_id"))


@query("PRJ4", f"with {TRACES} select cast(token_count > 300 as boolean) as failed, count(*) as n, sum(token_count) as tokens from traces group by 1")
def prj4(spark, sf_dir):
    from tidemark.operators.projections import split_errors

    t = traces(spark, sf_dir)
    good, bad = split_errors(t, F.when(F.col("token_count") > 300, F.lit("too long")), "input_order")
    both = good.select(F.lit(False).alias("failed"), "token_count").unionByName(bad.select(F.lit(True).alias("failed"), "token_count"))
    return both.groupBy("failed").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("tokens"))


@query("PRJ5", f"with {TRACES} select count(*) as n_valid from traces where dataset is not null and problem_id is not null and token_count >= 0 and correctness is not null")
def prj5(spark, sf_dir):
    from tidemark.operators.projections import require

    return require(traces(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_valid"))


_REG = "registry as (select * from (values ('click', 'math'), ('purchase', 'code'), ('view', 'logic')) v(dataset, registry_category))"


def _registry(spark):
    return spark.createDataFrame([("click", "math"), ("purchase", "code"), ("view", "logic")], "dataset string, registry_category string")


def _tagged(spark, sf_dir):
    t = traces(spark, sf_dir).withColumn("category", F.when(F.col("input_order") % 3 == 0, F.lit("Code")).when(F.col("input_order") % 3 == 1, F.lit("")))
    return t.join(F.broadcast(_registry(spark)), "dataset", "left")


_TAGGED = f"{TRACES}, {_REG}, tagged as (select *, case when input_order % 3 = 0 then 'Code' when input_order % 3 = 1 then '' end as category from traces left join registry using (dataset))"


@query("PRJ6", f"with {_TAGGED} select input_order, case when lower(coalesce(nullif(category, ''), registry_category, '')) = 'code' then 'code' else 'non_code' end as context_tag from tagged")
def prj6(spark, sf_dir):
    return _tagged(spark, sf_dir).select("input_order", S.context_tag(F.col("category"), F.col("registry_category")).alias("context_tag"))


@query("PRJ7", f"with {_TAGGED} select input_order, coalesce(registry_category, nullif(lower(trim(category)), ''), 'unknown') as category from tagged")
def prj7(spark, sf_dir):
    return _tagged(spark, sf_dir).select("input_order", S.dataset_category(F.col("dataset"), F.col("category"), F.col("registry_category")).alias("category"))


@query("JN4", f"with {_TAGGED} select dataset, registry_category, count(*) as n from tagged group by all")
def jn4(spark, sf_dir):
    return _tagged(spark, sf_dir).groupBy("dataset", "registry_category").agg(F.count(F.lit(1)).alias("n"))


@query("PRJ8", f"with {_TAGGED} select input_order, case when nullif(category, '') is not null then lower(category) when dataset in ('purchase', 'signup') then 'code' when dataset in ('click') then 'math' else 'logic' end as category from tagged")
def prj8(spark, sf_dir):
    from tidemark.operators.projections import scored_category

    c = scored_category(F.col("category"), F.col("dataset"), {"code": ["purchase", "signup"], "math": ["click"]}, "logic")
    return _tagged(spark, sf_dir).select("input_order", c.alias("category"))


@query("PRJ9", f"with {TRACES} select input_order, case input_order % 4 when 0 then correctness when 1 then 0.0 when 2 then cast(info_mode as double) else cast(cot_mode + 5 as double) end as topk_mass from traces")
def prj9(spark, sf_dir):
    from tidemark.operators.projections import topk_mass

    t = traces(spark, sf_dir)
    d = lambda c: F.col(c).cast("double")
    kind = F.col("input_order") % 4
    values = F.when(kind == 1, F.array().cast("array<double>")).when(kind == 2, F.array(F.lit(9.0), d("info_mode"))).when(kind == 3, F.array(*[F.lit(0.5)] * 4, d("cot_mode") + 5, F.lit(3.0)))
    return t.select("input_order", topk_mass(F.when(kind == 0, F.col("correctness")), values).alias("topk_mass"))


_B0 = BOUNDARIES


_STATE_NUMBERS = {
    "entropy": 0.0, "margin": 0.0, "top1_prob": 0.0, "top2_prob": 0.0, "topk_mass": 0.0, "eos_prob": 0.0, "eos_rank": 0.0, "repeat_ngram_ratio": 0.0,
    "progress_ratio": 1.0, "remaining_budget_ratio": 1.0, "segment_progress_ratio": 1.0,
}
_STATE_OTHERS = ("prompt", "context_tag", "prompt_len", "generated_tokens", "current_info_mode", "current_cot_mode", "boundary_kind", "is_answer_zone", "is_code_mode")


@query("PRJ10", f"""with {_B0} select trace_id, boundary_index, {', '.join(f'round(coalesce(nullif({c}, 0), {d}), 6) as {c}' for c, d in _STATE_NUMBERS.items())},
  prompt, case when is_code_mode then 'code' else 'non_code' end as context_tag, cast(length(prompt) as integer) as prompt_len, generated_tokens, chosen_info_mode as current_info_mode, chosen_cot_mode as current_cot_mode,
  coalesce(nullif(boundary_kind, ''), 'none') as boundary_kind, is_answer_zone, is_code_mode from boundaries""")
def prj10(spark, sf_dir):
    """All 20 fields of a boundary's state; a trace keeps its action, and samples of code are of the category ``Code``."""
    from tidemark.operators.projections import state_features

    b = boundary_samples(spark, sf_dir).withColumnsRenamed({"chosen_info_mode": "info_mode", "chosen_cot_mode": "cot_mode"})
    b = b.withColumn("category", F.when(F.col("is_code_mode"), F.lit("Code")).otherwise(F.lit(""))).drop("is_code_mode")
    s = state_features(b)  # fields are taken one by one, so that a reader of some shuffles no others
    return b.select("trace_id", "boundary_index", *[rounded(s[c], 6).alias(c) for c in _STATE_NUMBERS], *[s[c].alias(c) for c in _STATE_OTHERS])


@query("PRJ11", f"""with {_B0} select trace_id, boundary_index, round(least(1.0, generated_tokens / greatest(cast(1 as double), 64 + generated_tokens + 1)), 6) as progress_ratio,
  round(case when is_answer_zone then 0.0 else greatest(0, 64 - generated_tokens) / cast(64 as double) end, 6) as remaining_budget_ratio from boundaries""")
def prj11(spark, sf_dir):
    from tidemark.operators.projections import online_boundary

    b = boundary_samples(spark, sf_dir)
    progress, remaining = online_boundary(F.col("generated_tokens"), F.lit(64), F.col("generated_tokens"), F.col("is_answer_zone"))
    return b.select("trace_id", "boundary_index", rounded(progress, 6).alias("progress_ratio"), rounded(remaining, 6).alias("remaining_budget_ratio"))


_MODES = "modes as (select * from (values (1, 0.2, 0.8), (2, 0.5, 0.9), (3, 0.8, 0.95), (4, 1.1, 1.0)) v(info_mode, temperature, top_p))"


@query("PRJ12", f"with {TRACES}, {_MODES} select input_order, cast(temperature as double) as temperature_actual, cast(top_p as double) as top_p_actual from traces join modes using (info_mode)")
def prj12(spark, sf_dir):
    from tidemark.operators.projections import with_mode_settings

    modes = spark.createDataFrame([(1, 0.2, 0.8), (2, 0.5, 0.9), (3, 0.8, 0.95), (4, 1.1, 1.0)], "info_mode int, temperature double, top_p double")
    return with_mode_settings(traces(spark, sf_dir), modes).select("input_order", "temperature_actual", "top_p_actual")


@query("PRJ14", "select event_id, coalesce(nullif(case when event_id % 2 = 0 then '' else cast(user_id as varchar) end, ''), nullif(event_type, 'click'), 'ds_' || cast(event_id as varchar)) as problem_id from events")
def prj14(spark, sf_dir):
    from tidemark.operators.projections import first_id

    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 != 0, F.col("user_id").cast("string")).otherwise(F.lit("")).alias("a"), F.nullif(F.col("event_type"), F.lit("click")).alias("b"))
    return e.select("event_id", first_id(["a", "b"], F.concat(F.lit("ds_"), F.col("event_id").cast("string"))).alias("problem_id"))


@query("PRJ15", "select item_id, coalesce(nullif(case when item_id % 3 = 0 then null else cast(item_id * 7 as varchar) end, ''), 'bench_' || cast(item_id + 1 as varchar)) as problem_id, 'bench' as dataset from benchmark")
def prj15(spark, sf_dir):
    from tidemark.operators.projections import stable_items

    items = table(spark, sf_dir, "benchmark").withColumn("id", F.when(F.col("item_id") % 3 != 0, (F.col("item_id") * 7).cast("string")))
    return stable_items(items, ["id"], "bench", F.col("item_id") + 1).select("item_id", "problem_id", "dataset")


@query("PRJ16", f"""with {_B0} select trace_id, boundary_index, cast(greatest(0, round_even(remaining_budget_ratio * 64, 0)) as bigint) as remaining_tokens from boundaries""")
def prj16(spark, sf_dir):
    from tidemark.operators.projections import remaining_tokens

    return boundary_samples(spark, sf_dir).select("trace_id", "boundary_index", remaining_tokens(F.col("remaining_budget_ratio"), F.lit(64)).alias("remaining_tokens"))


@query("PRJ17", f"""with {TRACES}, ds as (select dataset, avg(token_count) as m, stddev_pop(token_count) as s from traces where dataset <> 'click' group by dataset), g as (select avg(token_count) as gm, stddev_pop(token_count) as gs from traces)
  select input_order, round(correctness - 0.2 * (token_count - coalesce(m, gm)) / coalesce(s, gs), 6) as score_proxy from traces left join ds using (dataset), g""")
def prj17(spark, sf_dir):
    t = traces(spark, sf_dir)
    stats = S.dataset_stats(t).where("dataset <> 'click'")
    return S.score_proxy(t, stats, 0.2).select("input_order", r("score_proxy"))


@query("PRJ18", f"with {TRACES} select distinct info_mode, cot_mode, cast((info_mode - 1) * 5 + cot_mode as integer) as action_index, 'i' || info_mode || '_c' || cot_mode as label, array_to_string(list_transform(range(20), lambda i: cast(i = (info_mode - 1) * 5 + cot_mode as integer)), '') as one_hot from traces")
def prj18(spark, sf_dir):
    from tidemark.operators.projections import action_label, one_hot

    i = S.action_index(F.col("info_mode"), F.col("cot_mode"))
    out = traces(spark, sf_dir).select("info_mode", "cot_mode").distinct()
    return out.select("info_mode", "cot_mode", i.alias("action_index"), action_label(F.col("info_mode"), F.col("cot_mode")).alias("label"), F.array_join(one_hot(i, 20), "").alias("one_hot"))


# --- filters, joins, sets -------------------------------------------------------------------------------------------


@query("FLT1", f"with {TRACES} select input_order from traces where (dataset, problem_id) in (select event_type, cast(user_id as varchar) from events where event_id < 50)")
def flt1(spark, sf_dir):
    allowed = traces(spark, sf_dir).where("input_order < 50").select(*KEY)
    return traces(spark, sf_dir).join(allowed, KEY, "left_semi").select("input_order")


@query("FLT3", f"with {TRACES} select input_order from traces where dataset in ('purchase', 'signup')")
def flt3(spark, sf_dir):
    return traces(spark, sf_dir).where(F.col("dataset").isin("purchase", "signup")).select("input_order")


@query("SET1", f"with {TRACES} select input_order, 'train' as split from traces where input_order % 2 = 0 union all select input_order, 'test' from traces where input_order % 2 = 1")
def set1(spark, sf_dir):
    t = traces(spark, sf_dir)
    part = lambda k, name: t.where(F.col("input_order") % 2 == k).select("input_order", F.lit(name).alias("split"))
    return part(0, "train").unionByName(part(1, "test"))


@query("SET2", f"with {TRACES} select distinct dataset, problem_id from traces")
def set2(spark, sf_dir):
    return traces(spark, sf_dir).select(*KEY).distinct()


_VAL = "md5('20260412:' || dataset || ':' || problem_id)"


@query("SMP1", f"""with {TRACES}, k as (select distinct dataset, problem_id from traces), o as (select *, row_number() over (order by {_VAL}, dataset, problem_id) as rk, count(*) over () as n from k)
  select dataset, problem_id, case when rk <= least(n - 1, greatest(1, cast(round_even(n * 0.15, 0) as bigint))) then 'val' else 'train' end as split from o""")
def smp1(spark, sf_dir):
    from tidemark.operators.splits import hash_split

    return hash_split(traces(spark, sf_dir), KEY, "20260412", 0.15)


@query("SET3", f"""with {TRACES}, k as (select distinct dataset, problem_id from traces), o as (select *, row_number() over (order by {_VAL}, dataset, problem_id) as rk, count(*) over () as n from k)
  select dataset, problem_id from o where rk > least(n - 1, greatest(1, cast(round_even(n * 0.15, 0) as bigint)))""")
def set3(spark, sf_dir):
    from tidemark.operators.splits import hash_split

    parts = hash_split(traces(spark, sf_dir), KEY, "20260412", 0.15)
    return parts.select(*KEY).join(parts.where("split = 'val'"), KEY, "left_anti")


@query("SMP2", f"""with {TRACES}, o as (select *, row_number() over (partition by dataset order by md5('20260412:' || dataset || ':' || cast(input_order as varchar)), input_order) as rk from traces)
  select dataset, input_order, case when rk <= 40 then 'train' else 'test' end as split from o where rk <= 140""")
def smp2(spark, sf_dir):
    from tidemark.operators.splits import exact_split

    return exact_split(traces(spark, sf_dir), "dataset", "input_order", "20260412", {"train": 40, "test": 100}).select("dataset", "input_order", "split")


@query("SET4", f"with {TRACES}, p as (select dataset, problem_id, list(distinct cot_mode) as got from traces group by all) select dataset, problem_id, array_to_string(list_sort(list_filter([0, 1, 2, 3, 4], lambda x: not list_contains(got, x))), ',') as missing from p")
def set4(spark, sf_dir):
    got = traces(spark, sf_dir).groupBy(*KEY).agg(F.collect_set("cot_mode").alias("got"))
    return got.select(*KEY, F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, range(5))), "got")), ",").alias("missing"))


@query("SET5", "select conv_id, array_to_string(list_transform(list_sort(list([f, r])), lambda x: x[2]), ',') as roles from (select conv_id, role as r, lpad(cast(min(turn) as varchar), 9, '0') as f from conversations group by conv_id, role) group by conv_id")
def set5(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.array_distinct(F.transform("t", lambda x: x["role"])), ",").alias("roles"))


@query("JN12", f"with {TRACES}, a as (select i.i as info, c.c as cot from range(1, 5) i(i), range(5) c(c)), k as (select distinct dataset, problem_id from traces) select dataset, problem_id, count(*) as n_actions, cast(sum((info - 1) * 5 + cot) as bigint) as index_sum from k, a group by all")
def jn12(spark, sf_dir):
    from tidemark.operators.projections import action_grid

    keys = traces(spark, sf_dir).select(*KEY).distinct()
    grid = keys.crossJoin(F.broadcast(action_grid(spark)))  # 20 actions
    return grid.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_actions"), F.sum(S.action_index(F.col("info_mode"), F.col("cot_mode"))).cast("bigint").alias("index_sum"))


@query("JN14", f"""with {SCORED}, m as (select dataset, info_mode, cot_mode, avg(score) as s from scored where dataset <> 'click' group by all), b as (select * from m qualify row_number() over (partition by dataset order by s desc, info_mode, cot_mode) = 1),
  g as (select info_mode as gi, cot_mode as gc from scored group by all order by avg(score) desc, 1, 2 limit 1), d as (select distinct dataset from traces)
  select dataset, coalesce(info_mode, gi) as info_mode, coalesce(cot_mode, gc) as cot_mode from d left join b using (dataset), g""")
def jn14(spark, sf_dir):
    from tidemark.operators.replay import start_actions

    s = scored(spark, sf_dir)
    return start_actions(s.select("dataset").distinct(), S.best_action(s.where("dataset <> 'click'"), ["dataset"]), S.best_action(s))


@query("SRC7", "with k as (select item_id, text, unnest([struct_pack(k := 'mbpp_' || (item_id % 50), o := 0), struct_pack(k := 'mbpp_' || (item_id + 3), o := 1)]) as e from benchmark) select e.k as key, arg_max(item_id, item_id * 2 + e.o) as item_id from k group by e.k")
def src7(spark, sf_dir):
    from tidemark.sources.benchmarks import double_keyed

    b = table(spark, sf_dir, "benchmark").withColumn("task_id", F.col("item_id") + 3).withColumn("i", F.col("item_id") % 50)
    return double_keyed(b, "mbpp_", "i", "task_id", "item_id").select("key", "item_id")


@query("SRC8", "select 'HumanEval/' || (item_id % 30) as task_id, max(item_id) as item_id from benchmark group by 1")
def src8(spark, sf_dir):
    from tidemark.sources.benchmarks import last_by_key

    b = table(spark, sf_dir, "benchmark").withColumn("task_id", F.concat(F.lit("HumanEval/"), (F.col("item_id") % 30).cast("string")))
    return last_by_key(b, "task_id", "item_id").select("task_id", "item_id")


@query("SRC10", f"with {TRACES}, o as (select *, row_number() over (partition by dataset order by input_order) - 1 as ix from traces) select dataset, input_order from o where (dataset = 'click' and ix >= 5 and ix < 25) or (dataset = 'view' and ix < 7)")
def src10(spark, sf_dir):
    from tidemark.sources.benchmarks import limited

    return limited(traces(spark, sf_dir), "dataset", "input_order", {"click": (5, 20), "view": (0, 30)}, limit={"view": 7}).select("dataset", "input_order")


@query("JN5", "with i as (select item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as p from benchmark), d as (select doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as p, doc_id as want from documents), u as (select p, min(item_id) as item_id from i group by p) select doc_id, coalesce(a.item_id, u.item_id) as item_id from d left join (select distinct item_id from i) a on a.item_id = d.want left join u on u.p = d.p")
def jn5(spark, sf_dir):
    from tidemark.functions.text import prompt_form
    from tidemark.sources.benchmarks import resolve_items

    items = table(spark, sf_dir, "benchmark").select("item_id", prompt_form(F.col("text")).alias("prompt"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("want"), prompt_form(F.col("text")).alias("prompt"))
    return resolve_items(docs, items, "want", "item_id", "prompt").select("doc_id", "item_id")


@query("JN6", "select doc_id, case when item_id is null then 'missing_item' end as error from documents left join benchmark on item_id = doc_id")
def jn6(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("there"))
    return table(spark, sf_dir, "documents").select("doc_id").join(items, "doc_id", "left").select("doc_id", F.when(F.col("there").isNull(), F.lit("missing_item")).alias("error"))


@query("SMP3")
def smp3(spark, sf_dir):
    """The problems as shards, in the order in which each of three epochs reads them."""
    from tidemark.operators.ordering import dense_index, epoch_place

    shards = dense_index(traces(spark, sf_dir).select(*KEY).distinct(), KEY)
    n = shards.count()
    epochs = shards.withColumn("epoch", F.explode(F.array(*map(F.lit, range(3)))))
    return epochs.select(*KEY, "epoch", epoch_place(F.col("place"), n, F.col("epoch")).alias("position"))
