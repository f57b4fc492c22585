"""Queries do the whole of what they stand for: every field, and every step until nothing moves."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import projections
from tidemark.plans import catalog

SMALL = "/root/testdata/sf0.001"
STATE = set(
    "prompt context_tag entropy margin top1_prob top2_prob topk_mass eos_prob eos_rank repeat_ngram_ratio prompt_len generated_tokens progress_ratio "
    "current_info_mode current_cot_mode remaining_budget_ratio segment_progress_ratio is_answer_zone is_code_mode boundary_kind".split()
)


def states(spark, schema, *rows):
    frame = spark.createDataFrame(rows, schema)
    return [r.s.asDict() for r in frame.select("k", projections.state_features(frame).alias("s")).orderBy("k").collect()]


def test_state_has_all_fields_with_what_they_fall_back_to(spark):
    (bare,) = states(spark, "k int", (0,))
    assert set(bare) == STATE and len(STATE) == 20
    assert (bare["context_tag"], bare["is_code_mode"], bare["current_info_mode"], bare["current_cot_mode"], bare["topk_mass"], bare["generated_tokens"]) == ("non_code", False, 0, 0, 0.0, 0)
    told = states(spark, "k int, category string, registry_category string, info_mode int, cot_mode int, current_cot_mode int, token_count bigint", (0, " Code ", None, 2, 3, 4, 9), (1, "math", "code", None, 1, None, None), (2, "math", None, 1, None, 0, 0))
    assert [(s["context_tag"], s["is_code_mode"], s["current_info_mode"], s["current_cot_mode"], s["generated_tokens"]) for s in told] == [("code", True, 2, 4, 9), ("code", True, 0, 1, 0), ("non_code", False, 1, 0, 0)]


def test_a_probe_comes_before_the_features_own_column(spark):
    schema = "k int, probe_entropy double, entropy double, probe_topk_mass array<double>, topk_mass_5 double, topk_mass double"
    got = states(spark, schema, (0, 0.5, 0.25, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 9.0, 8.0), (1, None, 0.25, None, 9.0, 8.0), (2, 0.0, 0.25, [], 9.0, 8.0), (3, None, None, None, None, 8.0))
    assert [(s["entropy"], s["topk_mass"]) for s in got] == [(0.5, 0.5), (0.25, 9.0), (0.0, 0.0), (0.0, 8.0)]


def test_the_state_query_gives_all_fields_and_shuffles_those_that_are_read(spark):
    rows = catalog.queries()["PRJ10"](spark, SMALL)
    assert set(rows.columns) == STATE | {"trace_id", "boundary_index"}
    some = rows.select("trace_id", "boundary_index", "entropy", "boundary_kind")
    told = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "simple")
    assert "concat(" not in told and "l_linestatus" not in told and "l_tax" not in told


def test_the_replays_centres_move_until_they_rest(spark, monkeypatch):
    from tidemark.operators import slots
    from tidemark.plans import vector_queries as Q

    fitted, plainly = [], slots.fit_centres

    def kept(rows, vector, **how):
        fitted.append((rows, vector, plainly(rows, vector, **how)))
        return fitted[-1][2]

    monkeypatch.setattr(slots, "fit_centres", kept)
    Q._replayed(spark, SMALL)
    ((rows, vector, centres),) = fitted
    x = np.array([r[0] for r in rows.select(V.l2_normal(F.col(vector))).collect()])
    near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    means = np.array([x[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
    moved = means / np.linalg.norm(means, axis=1, keepdims=True)
    again = plainly(rows, vector)
    assert np.allclose(centres, again, atol=1e-12) and np.abs(moved - centres).mean() < 5e-3
