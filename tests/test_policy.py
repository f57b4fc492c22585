"""Replay by a policy: lockstep walks against one problem at a time, spelt out; matches against a plain loop."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordering, policy, replay, training

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def plain_match(rows, anchor, weight, tolerance=0.03):
    best, top, gap = 0, -1.0, math.inf
    for k, row in enumerate(rows):
        if row["progress"] + tolerance < anchor["progress"]:
            continue
        w, g = weight(anchor, row), abs(row["progress"] - anchor["progress"])
        if w > top or abs(w - top) < 1e-8 and g < gap:
            best, top, gap = k, w, g
    if top > 0:
        return best
    counted = [(abs(r["progress"] - anchor["progress"]), k) for k, r in enumerate(rows) if r["progress"] + tolerance >= anchor["progress"]]
    return min(counted)[1] if counted else 0


def plain_policy(p, text, row, at, left):
    unit = text / max(1e-8, np.linalg.norm(text))
    near = np.exp((p.centres @ unit) / p.slot_temperature)
    known = np.concatenate((text, near / near.sum() @ p.slot_priors))
    initial = training.forward(p.prior, known[None])[-1][0]
    if row is None:
        return initial
    n = len(p.budgets)
    if row["answer"]:
        logits = training.forward(p.answer, np.concatenate((known, row["boundary"], np.eye(4)[at // n]))[None])[-1][0]
        rated = [0.15 * initial[k * n : k * n + n].mean() + logits[k] + (0.05 if k == at // n else -0.1) for k in range(4)]
        return np.array([rated[k // n] if k % n == at % n else -1e9 for k in range(4 * n)])
    logits = training.forward(p.think, np.concatenate((known, row["boundary"], np.eye(20)[at]))[None])[-1][0]
    return np.array([0.15 * initial[k] + logits[k] + (0.05 if k == at else -0.1) - (0.35 if p.budgets[k % n] > left else 0) for k in range(20)])


def plain_replay(p, actions, text, penalties, max_switches=8):
    def weight(a, b):
        if a["answer"] != b["answer"]:
            return 0.0
        d = sum(abs(x - y) for x, y in zip(a["features"], b["features"], strict=True)) + sum(c for c, x, y in zip(penalties, a["marks"], b["marks"], strict=True) if x != y)
        return w if (w := math.exp(-d / 0.75)) >= 1e-4 else 0.0

    initial = plain_policy(p, text, None, 0, 0)
    start = at = max(actions, key=lambda k: (initial[k], -k))
    rows, pos, switches = actions[at]["rows"] or [], 0, 0
    if not rows:
        return start, at, 0, actions[at]["token_count"]
    used = rows[0]["generated"]
    for _ in range(max(8, 2 * max(len(a["rows"] or []) for a in actions.values()))):
        row = rows[pos]
        left = round(p.budgets[at % 5] * min(1.0, max(0.0, row["remaining"])))
        to = int(plain_policy(p, text, row, at, left).argmax())
        target = (actions.get(to) or {}).get("rows")
        if to != at and switches >= max_switches:
            break
        if to != at and target:
            pos = plain_match(target, row, weight)
            at, rows, switches = to, target, switches + 1
        elif pos + 1 < len(rows):
            pos += 1
        else:
            break
        used = max(used, rows[pos]["generated"])
    return start, at, switches, used + max(0, actions[at]["token_count"] - rows[pos]["generated"])


@needs_tables
def test_lockstep_equals_one_problem_walks(spark):
    from tidemark.plans.vector_queries import PENALTIES, replay_rule, replay_traces

    rng = np.random.default_rng(2)
    priors = rng.random((5, 20))
    rule = replay_rule(rng.normal(size=(5, 16)), priors / priors.sum(axis=1, keepdims=True))
    traces = replay_traces(spark, SF)
    problems, stats, order = {}, {}, {}
    for r in traces.collect():
        key = (r.dataset, r.problem_id)
        stats.setdefault(key, []).append(r.token_count)
        if order.get((key, r.action), -1) < r.input_order:
            order[key, r.action] = r.input_order
            problems.setdefault(key, {})[r.action] = r.asDict(recursive=True)
    got = {(r.dataset, r.problem_id): r for r in policy.replay_policy(traces, rule, PENALTIES).collect()}
    assert set(got) == set(problems)
    for key, actions in problems.items():
        want = plain_replay(rule, actions, np.array(next(iter(actions.values()))["text"]), PENALTIES)
        r = got[key]
        assert (r.start, r.action, r.switches, r.token_count) == want
        std = float(np.std(stats[key])) if np.std(stats[key]) > 1e-6 else 1.0
        rate = lambda a, t, k=key, s=std: actions[a]["correctness"] - 0.2 * (t - float(np.mean(stats[k]))) / s  # noqa: B023, E731
        assert r.score == pytest.approx(rate(want[1], want[3])) and r.prior_score == pytest.approx(rate(want[0], actions[want[0]]["token_count"]))
    assert len({r.switches for r in got.values()}) > 1 and any(r.start != r.action for r in got.values())
    short = policy.replay_policy(traces, rule, PENALTIES, max_switches=0).collect()
    assert {r.switches for r in short} == {0} and all(r.start == r.action for r in short)


def test_near_ties_follow_the_running_best(spark):
    rng = random.Random(3)
    cases, rows = {}, []
    for t in range(120):
        listed = []
        for k in range(rng.randrange(1, 9)):
            listed.append({"progress": rng.choice([0.2, 0.46, 0.5, 0.53, 0.7]), "w": rng.choice([0.0, 0.0, 0.5, 0.5 + 6e-9, 0.5 - 6e-9, 0.5 + 1.2e-8, 0.6])})
            rows.append((1, 0.5, t, k, listed[-1]["progress"], listed[-1]["w"]))
        cases[t] = plain_match(listed, {"progress": 0.5}, lambda a, b: b["w"])
    rng.shuffle(rows)
    pairs = spark.createDataFrame(rows, "a int, anchor_progress double, t int, ix int, progress double, weight double")
    assert {r.t: r.matched for r in replay.match_rows(pairs, ["a"], ["t"], "ix").collect()} == cases


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0] * 900 + [1.0, 9.0], [0.5, 0.5, 7.0, 8.0], [None, 2.0, 4.0, 4.0], [float(k % 97) for k in range(1000)]])
def test_median_by_counts(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    known = [v for v in values if v is not None]
    assert ordering.exact_median(frame, F.col("v")).collect()[0].median == (float(np.median(known)) if known else None)


def test_run_summary(spark):
    schema = "baseline string, correctness double, score_proxy double, token_count bigint, think_token_count bigint, answer_token_count bigint, latency_sec double, switches int"
    rows = [("a", 1.0, 0.5, 10, 7, 3, 0.5, 2), ("a", 0.0, -0.5, 20, 15, 5, 1.5, 0), ("b", 1.0, 1.0, 4, 4, 0, 0.1, 0)]
    frame = spark.createDataFrame(rows, schema)
    got = {r.baseline: tuple(r)[1:] for r in replay.run_summary(frame, "baseline").collect()}
    assert got == {"a": (2.0, 0.5, 0.0, 15.0, 11.0, 4.0, 1.0, 1.0), "b": (1.0, 1.0, 1.0, 4.0, 4.0, 0.0, 0.1, 0.0)}
    assert tuple(replay.run_summary(frame.limit(0)).collect()[0]) == (0.0,) * 8
