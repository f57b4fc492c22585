"""Policies over stored traces: start actions, comparison with static and oracle policies, replay walks."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scoring import PROBLEM, best_action


# Fields of a run's rows, and their names in its summary.
RUN_FIELDS = (("correctness", "acc"), ("score_proxy", "score"), ("token_count", "tokens"), ("think_token_count", "think_tokens"), ("answer_token_count", "answer_tokens"), ("latency_sec", "latency_sec"), ("switches", "switches"))


def run_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Rows and seven means of an online run, by baseline or overall; zeros without a row."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(n) for c, n in RUN_FIELDS])


def policy_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Rows, mean correctness, score, tokens and (where the table has them) switches of a policy; zeros where there is no row."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), mean("correctness").alias("mean_correctness"), mean("score").alias("mean_score"), mean("token_count").alias("mean_tokens"),
        *([mean("switches").alias("mean_switches")] if "switches" in rows.columns else []),
    )


def compare_policies(scored: DataFrame, keys: Sequence[str] = PROBLEM) -> DataFrame:
    """Per problem the score of the best static action (null if not tried), of the smallest action, and of the oracle.

    One aggregation by problem; the best static action is one row.
    """
    static = best_action(scored).select(F.col("info_mode").alias("bi"), F.col("cot_mode").alias("bc"))
    last = scored.groupBy(*keys, "info_mode", "cot_mode").agg(F.max_by("score", "input_order").alias("score"))
    rows = last.crossJoin(F.broadcast(static))  # one row
    return rows.groupBy(*keys).agg(
        F.max(F.when((F.col("info_mode") == F.col("bi")) & (F.col("cot_mode") == F.col("bc")), F.col("score"))).alias("static_score"),
        F.min_by("score", F.struct("cot_mode", "info_mode")).alias("prior_score"),
        F.max("score").alias("oracle_score"),
    )


def paired_comparison(rows: DataFrame, policy: str, static: str, oracle: str) -> DataFrame:
    """Mean difference, share of strict wins, and regret against the oracle, over problems that both policies have."""
    p, s = F.col(policy), F.col(static)
    return rows.where(p.isNotNull() & s.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p - s).alias("mean_delta"), F.avg((p > s).cast("double")).alias("win_rate"), F.avg(F.col(oracle) - p).alias("oracle_regret")
    )


def start_actions(datasets: DataFrame, by_dataset: DataFrame, overall: DataFrame) -> DataFrame:
    """The start action of each dataset; the overall one where it has none."""
    world = overall.select(F.col("info_mode").alias("gi"), F.col("cot_mode").alias("gc"))
    rows = datasets.join(F.broadcast(by_dataset.select("dataset", "info_mode", "cot_mode")), "dataset", "left").crossJoin(F.broadcast(world))  # one row
    return rows.select("dataset", F.coalesce("info_mode", "gi").alias("info_mode"), F.coalesce("cot_mode", "gc").alias("cot_mode"))


def trace_states(traces: DataFrame, boundaries: DataFrame, keys: Sequence[str] = PROBLEM) -> DataFrame:
    """One row by problem and action: its last trace, and that action's boundaries in order as an array."""
    fields = [c for c in traces.columns if c not in (*keys, "info_mode", "cot_mode")]
    last = traces.groupBy(*keys, "info_mode", "cot_mode").agg(F.max_by(F.struct(*fields), "input_order").alias("trace"))
    rest = [c for c in boundaries.columns if c not in (*keys, "info_mode", "cot_mode", "boundary_index")]
    nested = boundaries.groupBy(*keys, "info_mode", "cot_mode").agg(F.array_sort(F.collect_list(F.struct("boundary_index", *rest))).alias("boundaries"))
    return last.join(nested, [*keys, "info_mode", "cot_mode"], "left")


def match_rows(pairs: DataFrame, anchor: Sequence[str], target: Sequence[str], order: str, tolerance: float = 0.03) -> DataFrame:
    """For each anchor and target trace, the target's boundary that a switch lands on: ``(anchor, target, matched)``.

    ``pairs`` has one row for each boundary of a target trace (``order``: its place there) with ``anchor_progress``,
    ``progress`` and the kernel ``weight`` (0 where the kernel rules it out). Boundaries are taken in order; those that lie
    back by more than ``tolerance`` do not count. One replaces the best so far if its weight is larger, or within 1e-8 of
    it and its gap in progress smaller: near ties are decided against the running best, so a chain of them can drift.
    Without a positive weight the smallest gap wins, without any boundary that counts the first one. A group holds the
    boundaries of one trace.
    """
    gap = F.abs(F.col("progress") - F.col("anchor_progress"))
    near = F.col("progress") + tolerance >= F.col("anchor_progress")
    grouped = pairs.groupBy(*anchor, *target).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("bigint").alias("k"), F.col("weight").cast("double").alias("w"), gap.cast("double").alias("g"), near.alias("near")))).alias("rows"))
    begin = F.struct(F.lit(None).cast("bigint").alias("k"), F.lit(-1.0).alias("w"), F.lit(float("inf")).alias("g"))

    def step(best: Column, row: Column) -> Column:
        better = row["near"] & ((row["w"] > best["w"]) | ((F.abs(row["w"] - best["w"]) < 1e-8) & (row["g"] < best["g"])))
        return F.when(better, F.struct(row["k"].alias("k"), row["w"].alias("w"), row["g"].alias("g"))).otherwise(best)

    ranked = lambda rows: F.transform(F.filter(rows, lambda r: r["near"]), lambda r: F.struct(r["g"].alias("g"), r["k"].alias("k")))
    folded = grouped.select(*anchor, *target, F.aggregate("rows", begin, step).alias("best"), F.array_min(ranked("rows"))["k"].alias("closest"), F.get("rows", F.lit(0))["k"].alias("first"))
    matched = F.coalesce(F.when(F.col("best.w") > 0, F.col("best.k")), F.col("closest"), F.col("first"))
    return folded.select(*anchor, *target, matched.cast(pairs.schema[order].dataType).alias("matched"))


def choose_action(scores: Sequence[float], current: int, remaining: float, answer: bool, budgets: Sequence[float], hysteresis: float = 0.05, switch_cost: float = 0.1, guardrail: float = 0.35) -> int:
    """The best joint action at a boundary, the first one where equal.

    Staying has a bonus, switching a cost, and so has a budget beyond what is left. In the answer zone only the info modes
    compete, by their mean over budgets, and the budget level stays.
    """
    n = len(budgets)
    if answer:
        means = [sum(scores[k : k + n]) / n + (hysteresis if k // n == current // n else -switch_cost) for k in range(0, len(scores), n)]
        return max(range(len(means)), key=means.__getitem__) * n + current % n
    rated = [s + (hysteresis if k == current else -switch_cost) - (guardrail if budgets[k % n] > remaining else 0.0) for k, s in enumerate(scores)]
    return max(range(len(rated)), key=rated.__getitem__)


def _landing(rows: Sequence[dict], here: dict, tolerance: float, temperature: float, least_weight: float) -> int:
    """Place among a trace's boundaries that a switch from ``here`` lands on."""
    best = None
    for k, row in enumerate(rows):
        if row["progress"] + tolerance < here["progress"]:
            continue
        distance = sum(abs(a - b) for a, b in zip(row["features"], here["features"], strict=True)) + sum(w for w, a, b in zip(here["penalties"], row["marks"], here["marks"], strict=True) if a != b)
        weight = math.exp(-distance / max(1e-6, temperature)) if row["answer"] == here["answer"] else 0.0
        rank = (-round(weight if weight >= least_weight else 0.0, 8), abs(row["progress"] - here["progress"]), k)
        best = rank if best is None else min(best, rank)
    return 0 if best is None else best[2]


def _walk(actions: Mapping[int, dict], start: int, budgets: Sequence[float], max_switches: int, tolerance: float, temperature: float, least_weight: float) -> tuple[int, int, int]:
    """Final action, switches and tokens of one problem's walk."""
    at, step, switches = start, 0, 0
    rows = actions[at]["rows"] or []
    if not rows:
        return at, 0, actions[at]["token_count"]
    here = rows[0]
    used = here["generated"]
    for _ in range(max(8, 2 * max(len(a["rows"] or ()) for a in actions.values()))):
        target = choose_action(here["scores"], at, here["remaining"], here["answer"], budgets)
        if target != at and switches >= max_switches:
            break
        landing = (actions.get(target) or {}).get("rows") if target != at else None
        if landing:
            step = _landing(landing, here, tolerance, temperature, least_weight)
            at, rows, switches = target, landing, switches + 1
        elif step + 1 < len(rows):
            step += 1
        else:
            break
        here = rows[step]
        used = max(used, here["generated"])
    return at, switches, used + max(0, actions[at]["token_count"] - here["generated"])


def replay_walks(
    states: DataFrame, budgets: Sequence[float], max_switches: int = 8, tolerance: float = 0.03, temperature: float = 0.75, least_weight: float = 1e-4, keys: Sequence[str] = PROBLEM
) -> DataFrame:
    """Walk each problem's stored traces as a policy would have: ``(keys, action, switches, token_count, correctness)``.

    ``states(keys, start, action, token_count, correctness, rows)``: one row by action, so a problem has as many rows as
    there are actions at most; ``rows`` are that trace's boundaries in order, with the policy's joint ``scores`` at each,
    standardised kernel ``features``, and categorical ``marks`` with the ``penalties`` of their mismatch. At a boundary the
    policy stays (the walk goes on to the next one) or switches: the walk lands on the matching boundary of the other
    trace, or goes on if that has none. It ends behind the last boundary, where a switch is wanted beyond
    ``max_switches``, or after max(8, twice the longest trace) steps. Tokens: the most consumed, and what is left of the
    final trace. A problem without a trace of its start action begins with its smallest action.
    """
    import pyarrow as pa

    row = F.struct("action", "token_count", "correctness", "rows")
    grouped = states.groupBy(*keys).agg(F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("action", row.alias("a")))).alias("actions"))
    n = len(keys)

    def run(batches):
        for b in batches:
            ends = []
            for start, listed in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True):
                actions = {x["action"]: x["a"] for x in listed}
                start = start if start in actions else min(actions)
                at, switches, tokens = _walk(actions, start, budgets, max_switches, tolerance, temperature, least_weight)
                ends.append((at, switches, tokens, actions[at]["correctness"]))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64())
            made = [pa.array([e[k] for e in ends], type=t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *made], names=[*keys, "action", "switches", "token_count", "correctness"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.schema if f.name in keys)
    return grouped.mapInArrow(run, f"{schema}, action int, switches int, token_count bigint, correctness double")
