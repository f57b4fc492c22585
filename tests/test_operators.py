"""Operators against hand-computed micro-cases and invariants."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import grading as G
from tidemark.functions import text as T
from tidemark.functions import vectors as V
from tidemark.operators import neighborhood as N
from tidemark.operators import passk, projections, scoring, slots, splits
from tidemark.operators.pairs import preference_pairs
from tidemark.streaming.segmentation import Segmenter

TRACES = "dataset string, problem_id string, info_mode int, cot_mode int, correctness double, token_count bigint, input_order bigint"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def values(spark, f, cases):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, s string")
    return [r.x for r in rows.select("k", f(F.col("s")).alias("x")).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (T.number_text, {"1,234.0": "1234", "": "", "abc": "abc", "2.50": "2.5"}),
        (T.choice, {"FINAL_ANSWER: (c)": "C", "The answer is B": "B", "x\nD.": "D", "choose between": "B", "": ""}),
        (T.boxed, {r"\boxed{1} \boxed{\frac{1}{2}}": r"\frac{1}{2}", "none": "", r"\boxed{a{b": "a{b"}),
        (T.math_text, {"so #### 1,200": "1200", "FINAL_ANSWER: 7.0": "7", "$x+1$": "x+1", "it was 3": "itwas3"}),
        (T.bool_text, {"yes. answer is no": "false", "none": "", "It is True": "true"}),
        (T.boundary_kind, {"a\nb.": "newline", "done.": "punct", "": "", "word": "", "Step 2: go": "step_marker"}),
        (T.code_text, {"```python\nx  = 1\n\n```": "x = 1", "a\n\n b": "a\nb"}),
        (T.without_reasoning, {"<think>a</think>b": " b", "a</think> b ": "b", "a</think>": "a</think>"}),
        (G.normal_answer, {r"\dfrac12": r"\frac{1}{2}", "0.5": r"\frac{1}{2}", "x=3": "3", "2/4": r"\frac{2}{4}", r"\sqrt2": r"\sqrt{2}", r"5\text{ cm}": "5"}),
        (G.grader_form, {"1,234": "1234", "$5": "5", "3 cm": "3", "1 1/2": "1+1/2", "5.0": "5", "2 million": "2*10^6"}),
    ],
)
def test_text_cases(spark, function, cases):
    assert values(spark, function, list(cases)) == list(cases.values())


def test_grades(spark):
    pairs = {("1,000", "1000"): True, ("(1,2)", "( 1, 2 )"): True, ("(1,2)", "[1,2]"): False, ("1/2", "0.5"): True, ("x", "y"): False}
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    rows = G.compare_answers(rows, F.col("a"), F.col("b"), "x").orderBy("k")
    assert [r.x for r in rows.collect()] == list(pairs.values())


def test_scores_stats_and_lambda(spark):
    rows = [("d", "p", 1, 0, 1.0, 1, 0), ("d", "p", 1, 1, 1.0, 3, 1), ("d", "q", 1, 0, 0.0, 5, 2), ("d", "q", 1, 1, 0.0, 5, 3), ("d", "q", 2, 1, 0.0, 5, 4)]
    t = spark.createDataFrame(rows, TRACES)
    scored = scoring.score_traces(t)
    assert [round(r.score, 9) for r in scored.orderBy("input_order").collect()] == [1.2, 0.8, 0, 0, 0]
    stats = {r.problem_id: (r.mean_tokens, r.std_tokens) for r in scoring.token_stats(t).collect()}
    assert stats == {"p": (2.0, 1.0), "q": (5.0, 1.0)}
    assert round(scoring.recover_lambda(scored).collect()[0].lam, 9) == 0.2
    assert {r.problem_id: r.reasons for r in scoring.hard_examples(scored).collect()} == {"p": ["high_token_z"], "q": ["all_incorrect"]}
    pairs = preference_pairs(scored, ["dataset", "problem_id"], ["input_order"], ["input_order"]).collect()
    assert [(p.problem_id, p.winner_input_order, round(p.score_gap, 9), round(p.pair_weight, 9)) for p in pairs] == [("p", 0, 0.4, 1.0)]


def test_pass_at_k(spark):
    def exact(n, c, k):
        k = min(n, k)
        return 0.0 if c == 0 else 1 - math.comb(n - c, k) / math.comb(n, k)

    cases = [(10, 3, 5), (2, 1, 5), (4, 0, 1), (7, 7, 3)]
    for n, c, k in cases:
        assert abs(one(spark, passk.estimator(F.lit(n), F.lit(c), F.lit(k))) - exact(n, c, k)) < 1e-12


def test_projections(spark):
    cases = [(0.4, None, 0.4), (None, [], 0.0), (None, [0.1, 0.2], 0.2), (None, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 0.5), (None, None, 0.0)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a double, b array<double>")
    assert [r.x for r in rows.select("k", projections.topk_mass(F.col("a"), F.col("b")).alias("x")).orderBy("k").collect()] == [c[2] for c in cases]
    progress, left = projections.online_boundary(F.lit(10), F.lit(64), F.lit(10), F.lit(False))
    assert (one(spark, progress), one(spark, left)) == (10 / 75, 54 / 64)
    assert one(spark, projections.action_label(F.lit(4), F.lit(4))) == "i4_c4"
    with pytest.raises(Exception, match="token_count"):
        projections.require(spark.createDataFrame([("d", "p", 1, 1, 1.0, -1, 0)], TRACES)).collect()


def test_splits(spark):
    assert [splits.val_size(n, f) for n, f in ((10, 0.15), (10, 0.25), (1, 0.15), (2, 0.9))] == [2, 2, 0, 1]
    keys = spark.createDataFrame([("d", str(k)) for k in range(40)] * 2, "dataset string, problem_id string")
    parts = {(r.problem_id): r.split for r in splits.hash_split(keys, ["dataset", "problem_id"], "7", 0.15).collect()}
    assert len(parts) == 40 and list(parts.values()).count("val") == 6
    train, val = splits.exact_problem_split([("d", str(k)) for k in range(10)], 1, 0.15)
    assert len(val) == 2 and not set(train) & set(val)
    with pytest.raises(ValueError):
        splits.exact_split(keys, "dataset", "problem_id", "7", {"train": 100}, strict=True)


def test_vectors(spark):
    a = F.array(*map(F.lit, (1.0, 2.0, 2.0)))
    assert abs(sum(one(spark, V.softmax(a, 0.25))) - 1) < 1e-12
    assert one(spark, V.argmax(a)) == 1
    assert abs(one(spark, V.dot(V.l2_normal(a), V.l2_normal(a))) - 1) < 1e-12
    assert one(spark, V.repeat_ratio(F.array(*map(F.lit, (1, 2, 3, 1, 2, 3, 1))))) == pytest.approx(0.4)
    assert one(spark, V.group_means(F.array(*[F.lit(float(x)) for x in range(4)]), 2, 2)) == [0.5, 2.5]
    assert one(spark, V.dense_scores(F.create_map(F.lit(1), F.lit(3.0)), 3)) == [1.0, 3.0, 1.0]


def test_neighbours_include_the_anchor(spark):
    rows = [("d", "p", k, 0, k / 5, 1 - k / 5, 0.1 * k, 0.2, 10 * k, "A", k % 2 == 0, float(k)) for k in range(6)]
    b = spark.createDataFrame(rows, "dataset string, problem_id string, trace_id int, boundary_index int, progress_ratio double, remaining_budget_ratio double, entropy double, margin double, generated_tokens int, boundary_kind string, is_answer_zone boolean, score double")
    pairs = N.neighbour_pairs(b, ["trace_id"], ["trace_id", "score"])
    got = {(r.anchor_trace_id, r.candidate_trace_id): r.weight for r in pairs.collect()}
    assert all(got[k, k] == 1.0 for k in range(6)) and all((i + j) % 2 == 0 for i, j in got)
    assert N.top_neighbours(pairs, ["anchor_trace_id"], ["candidate_trace_id"], k=2).count() == 12


def test_segmenter():
    s = Segmenter(budget=9)
    cuts = [b for t in ["a "] * 5 + ["b. "] + ["c "] * 7 + ["d.\n"] if (b := s.push(t))]
    assert [(c["token_index"], c["boundary_kind"], c["is_answer_zone"]) for c in cuts] == [(6, "punct", False), (14, "newline", True)]
    assert Segmenter().push("x.") is None


def test_hash_buckets_are_stable(spark):
    offsets = [one(spark, T.rotation(F.lit(f"k{i}"), 4)) for i in range(8)]
    assert set(offsets) <= set(range(4)) and len(set(offsets)) > 1
    for o in range(4):
        turned = one(spark, T.rotated(F.array(*map(F.lit, "wxyz")), F.lit(o)))
        assert turned["ABCD".index(one(spark, T.rotated_letter(F.lit(o))))] == "w"


def test_registry_is_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(list(itertools.islice(entry.queries(), 100))) >= 90


def test_slot_centres_are_fitted_on_all_rows(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) + 4 * rng.normal(size=(5, 6))[rng.integers(0, 5, 400)]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, e array<double>").repartition(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for sample in (50, 400):
        first = sorted(r.vec_id for r in frame.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect())
        centres = unit[first][np.random.default_rng(42).choice(sample, 4, replace=False)]
        for _ in range(25):
            near = ((unit[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            moved = np.stack([unit[near == j].mean(0) if (near == j).any() else centres[j] for j in range(4)])
            shift, centres = np.abs(moved - centres).mean(), moved
            if shift < 1e-5:
                break
        want = centres / np.linalg.norm(centres, axis=1, keepdims=True)
        assert np.allclose(slots.fit_centres(frame, "e", k=4, sample_rows=sample), want, atol=1e-9)
