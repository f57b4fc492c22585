"""Replay of stored traces by a scoring policy: networks and slot memory choose, boundary by boundary.

All problems of a batch walk in lockstep. Each step scores the boundaries on which the walks stand in one pass through the
networks, moves the walks that stay, and lands those that switch on the matching boundary of the other trace.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.scoring import PROBLEM, safe_std
from tidemark.operators.training import Layers, forward


@dataclass
class Policy:
    """What scores the joint actions at a boundary; actions are info mode by budget level.

    ``prior`` reads (text, slots), ``think`` (text, slots, boundary, one-hot action), ``answer`` (text, slots, boundary,
    one-hot info mode).
    """

    centres: np.ndarray
    slot_priors: np.ndarray
    prior: Layers
    think: Layers
    answer: Layers
    budgets: Sequence[int]
    infos: int = 4
    # Temperature, weights, costs and bonus of the default policy.
    slot_temperature: float = 0.35
    prior_weight: float = 0.15
    boundary_weight: float = 1.0
    switch_cost: float = 0.1
    hysteresis: float = 0.05
    guardrail: float = 0.35
    _levels: int = field(init=False)

    def __post_init__(self):
        self._levels = len(self.budgets)

    @property
    def size(self) -> int:
        return self.infos * self._levels

    def slots(self, text: np.ndarray) -> np.ndarray:
        """Mixture of the slots' priors by softmaxed cosine similarity."""
        unit = text / np.maximum(1e-8, np.linalg.norm(text, axis=1, keepdims=True))
        near = unit @ self.centres.T / max(1e-6, self.slot_temperature)
        weight = np.exp(near - near.max(axis=1, keepdims=True))
        return weight / np.maximum(1e-8, weight.sum(axis=1, keepdims=True)) @ self.slot_priors

    def initial(self, known: np.ndarray) -> np.ndarray:
        """Scores of the start actions from (text, slots)."""
        return forward(self.prior, known)[-1]

    def scores(self, known: np.ndarray, initial: np.ndarray, boundary: np.ndarray, current: np.ndarray, remaining: np.ndarray, answer: np.ndarray) -> np.ndarray:
        """Joint scores, a row for each boundary; in the answer zone info modes compete and the budget level stays."""
        levels, out = self._levels, np.full((len(known), self.size), -np.inf)
        row = np.flatnonzero(~answer)
        if row.size:
            x = np.concatenate((known[row], boundary[row], np.eye(self.size)[current[row]]), axis=1)
            rated = self.prior_weight * initial[row] + self.boundary_weight * forward(self.think, x)[-1] - self.switch_cost
            rated[np.arange(row.size), current[row]] += self.switch_cost + self.hysteresis
            cost = np.tile(np.asarray(self.budgets, dtype=float), self.infos)
            out[row] = rated - self.guardrail * (cost[None] > remaining[row, None])
        row = np.flatnonzero(answer)
        if row.size:
            info, level = current[row] // levels, current[row] % levels
            x = np.concatenate((known[row], boundary[row], np.eye(self.infos)[info]), axis=1)
            means = initial[row].reshape(row.size, self.infos, levels).mean(axis=2)
            rated = self.prior_weight * means + self.boundary_weight * forward(self.answer, x)[-1] - self.switch_cost
            rated[np.arange(row.size), info] += self.switch_cost + self.hysteresis
            for k in range(self.infos):
                out[row, k * levels + level] = rated[:, k]
        return out


def landing(anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray], first: np.ndarray, count: np.ndarray, tolerance: float, temperature: float, least_weight: float) -> np.ndarray:
    """For each anchor, the place among its ``count`` candidate rows from ``first`` on that a switch lands on.

    Candidates are taken in order. One behind the anchor by more than ``tolerance`` does not count. It replaces the best so
    far if its weight is larger, or within 1e-8 of it and the gap in progress smaller. Without a positive weight the
    smallest gap wins, without a candidate that counts the first row.
    """
    best, weight, gap = np.zeros(len(first), dtype=np.int64), np.full(len(first), -1.0), np.full(len(first), np.inf)
    near, near_gap = np.zeros(len(first), dtype=np.int64), np.full(len(first), np.inf)
    for k in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > k)
        at = first[live] + k
        away = np.abs(rows["progress"][at] - anchors["progress"][live])
        counts = rows["progress"][at] + tolerance >= anchors["progress"][live]
        distance = np.abs(rows["features"][at] - anchors["features"][live]).sum(axis=1) + ((rows["marks"][at] != anchors["marks"][live]) * rows["penalties"]).sum(axis=1)
        w = np.exp(-distance / max(1e-6, temperature))
        w = np.where((w >= least_weight) & (rows["answer"][at] == anchors["answer"][live]), w, 0.0)
        better = counts & ((w > weight[live]) | ((np.abs(w - weight[live]) < 1e-8) & (away < gap[live])))
        best[live[better]], weight[live[better]], gap[live[better]] = k, w[better], away[better]
        closer = counts & (away < near_gap[live])
        near[live[closer]], near_gap[live[closer]] = k, away[closer]
    return np.where(weight > 0, best, near)


def walk(policy: Policy, text: np.ndarray, first: np.ndarray, count: np.ndarray, tokens: np.ndarray, rows: dict[str, np.ndarray], max_switches: int = 8, tolerance: float = 0.03, temperature: float = 0.75, least_weight: float = 1e-4):
    """Start, final action, switches and tokens of each problem's walk.

    ``first`` and ``count`` (problems by actions) place a trace's boundaries in ``rows``; ``tokens`` is -1 where a problem
    has no trace of an action. The start is the action of the highest prior score among those that it has.
    """
    n, each = len(text), np.arange(len(text))
    known = np.concatenate((text, policy.slots(text)), axis=1)
    initial = policy.initial(known)
    start = np.where(tokens >= 0, initial, -np.inf).argmax(axis=1)
    at, place, switches = start.copy(), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    walking = count[each, at] > 0
    row = np.where(walking, first[each, at], 0)
    used = np.where(walking, rows["generated"][row] if len(rows["generated"]) else 0, 0)
    steps = np.maximum(8, 2 * count.max(axis=1, initial=0))
    budgets = np.asarray(policy.budgets, dtype=float)
    step = 0
    begun = walking.copy()
    while True:
        p = np.flatnonzero(walking & (step < steps))
        if not p.size:
            break
        step += 1
        here = row[p]
        left = np.round(budgets[at[p] % len(budgets)] * np.clip(rows["remaining"][here], 0, 1))
        target = policy.scores(known[p], initial[p], rows["boundary"][here], at[p], left, rows["answer"][here]).argmax(axis=1)
        moves = target != at[p]
        ended = moves & (switches[p] >= max_switches)
        jumps = moves & ~ended & (count[p, target] > 0)
        stays = ~ended & ~jumps
        walking[p[ended]] = False
        q, to = p[jumps], target[jumps]
        if q.size:
            anchors = {c: rows[c][row[q]] for c in ("progress", "features", "marks", "answer")}
            place[q] = landing(anchors, rows, first[q, to], count[q, to], tolerance, temperature, least_weight)
            at[q], switches[q] = to, switches[q] + 1
        q = p[stays]
        done = place[q] + 1 >= count[q, at[q]]
        walking[q[done]] = False
        place[q[~done]] += 1
        on = p[walking[p]]
        row[on] = first[on, at[on]] + place[on]
        used[on] = np.maximum(used[on], rows["generated"][row[on]])
    whole = tokens[each, at]
    consumed = used + np.maximum(0, whole - rows["generated"][row]) if len(rows["generated"]) else whole
    return start, at, switches, np.where(begun, consumed, whole)


def _problems(traces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a problem: its text, token statistics, traces by action, and their boundaries one after the other."""
    # one shuffle by problem and one sort serve the last traces, the statistics and the lists
    of_action, of_problem = Window.partitionBy(*keys, "action").orderBy(F.col("input_order").desc_nulls_last()), Window.partitionBy(*keys)
    placed = traces.select(*keys, "action", "input_order", "token_count", "correctness", "text", "rows").repartition(*keys).withColumn("place", F.row_number().over(of_action)).withColumns({
        "mean_tokens": F.avg("token_count").over(of_problem), "std_tokens": safe_std(F.stddev_pop("token_count").over(of_problem), 1e-6),
        "text": F.first("text", ignorenulls=True).over(of_problem),
    })
    rows = F.coalesce("rows", F.array().cast(traces.schema["rows"].dataType))
    entry = F.struct("action", "token_count", "correctness", F.size(rows).alias("n"), rows.alias("rows"))
    # an action counts once, so a problem has as many entries as there are actions at most
    told = [F.first(c).alias(c) for c in ("text", "mean_tokens", "std_tokens")]
    grouped = placed.where("place = 1").groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("a"), *told)
    flat = F.flatten(F.transform("a", lambda x: x["rows"]))
    field_of = lambda array, c: F.transform(array, lambda x: x[c])
    taken = [field_of("a", c).alias(c) for c in ("action", "token_count", "correctness", "n")]
    of_rows = [field_of("flat", c).alias(f"row_{c}") for c in ("progress", "generated", "remaining", "answer")]
    lists = [F.flatten(field_of("flat", c)).alias(f"row_{c}") for c in ("boundary", "features", "marks")]
    return grouped.withColumn("flat", flat).select(*keys, "text", *taken, *of_rows, *lists, "mean_tokens", "std_tokens")


def replay_policy(traces: DataFrame, policy: Policy, penalties: Sequence[float], lam: float = 0.2, keys: Sequence[str] = PROBLEM, **how) -> DataFrame:
    """Per problem the policy's walk and its start action alone, both rated by the problem's token statistics.

    ``traces(keys, action, input_order, token_count, correctness, text, rows)``: of an action's traces the last one counts;
    ``text`` is the problem's vector, and ``rows`` are the trace's boundaries in order: ``progress, generated, remaining
    (share of the budget), answer, boundary, features, marks`` (vector of the networks; standardised kernel features; codes
    of kernel categories, whose mismatches cost ``penalties``). A trace may have no boundaries. Result: ``start, action,
    switches, token_count, correctness, score, prior_tokens, prior_correctness, prior_score``. ``how`` goes to :func:`walk`.
    """
    held = traces.sparkSession.sparkContext.broadcast(policy)
    problems = _problems(traces, keys)
    columns = [f.name for f in problems.schema]
    out = [("start", pa.int32()), ("action", pa.int32()), ("switches", pa.int32()), ("token_count", pa.int64()), ("correctness", pa.float64()), ("score", pa.float64()), ("prior_tokens", pa.int64()), ("prior_correctness", pa.float64()), ("prior_score", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        policy = held.value
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            values = lambda c, kind=np.float64: b.column(columns.index(c)).flatten().to_numpy(zero_copy_only=False).astype(kind)
            sizes = np.diff(b.column(columns.index("action")).offsets.to_numpy())
            owner, action, per = np.repeat(np.arange(n), sizes), values("action", np.int64), values("n", np.int64)
            first, count, tokens = (np.full((n, policy.size), x, dtype=np.int64) for x in (0, 0, -1))
            right = np.zeros((n, policy.size))
            first[owner, action], count[owner, action] = np.cumsum(per) - per, per
            tokens[owner, action], right[owner, action] = values("token_count", np.int64), values("correctness")
            total = int(per.sum())
            shaped = lambda c, kind=np.float64: values(c, kind).reshape(total, -1) if total else np.zeros((0, 0), dtype=kind)
            rows = {
                "progress": values("row_progress"), "generated": values("row_generated", np.int64), "remaining": values("row_remaining"), "answer": values("row_answer", bool),
                "boundary": shaped("row_boundary"), "features": shaped("row_features"), "marks": shaped("row_marks", np.int64), "penalties": np.asarray(penalties, dtype=float),
            }
            start, at, switches, used = walk(policy, values("text").reshape(n, -1), first, count, tokens, rows, **how)
            each = np.arange(n)
            mean, std = (b.column(columns.index(c)).to_numpy(zero_copy_only=False) for c in ("mean_tokens", "std_tokens"))
            rated = lambda c, t: right[each, c] - lam * ((t - mean) / std)
            made = [start, at, switches, used, right[each, at], rated(at, used), tokens[each, start], right[each, start], rated(start, tokens[each, start])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *(pa.array(v, type=t) for v, (_, t) in zip(made, out, strict=True))], names=[*keys, *(c for c, _ in out)])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in problems.schema if f.name in keys)
    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.float64(): "double"}
    return problems.mapInArrow(run, kept + "".join(f", {c} {kinds[t]}" for c, t in out))


def compare_with_static(replayed: DataFrame, scored: DataFrame, keys: Sequence[str] = PROBLEM) -> DataFrame:
    """``replayed`` with ``static_score`` (best action overall; null if the problem lacks it) and ``oracle_score`` by problem."""
    from tidemark.operators.replay import compare_policies

    return replayed.join(compare_policies(scored, keys).select(*keys, "static_score", "oracle_score"), list(keys))


def replay_summary(compared: DataFrame) -> DataFrame:
    """One row: problems, mean score of each policy, and of the replay against static and prior the mean difference and the share of strict wins; its regret."""
    against = lambda c, name: [F.avg(F.col("score") - F.col(c)).alias(f"delta_{name}"), F.avg((F.col("score") > F.col(c)).cast("double")).alias(f"wins_{name}")]
    means = [F.avg(c).alias(f"mean_{n}") for n, c in (("replay", "score"), ("prior", "prior_score"), ("static", "static_score"), ("oracle", "oracle_score"))]
    return compared.agg(F.count(F.lit(1)).alias("n"), *means, *against("static_score", "static"), *against("prior_score", "prior"), F.avg(F.col("oracle_score") - F.col("score")).alias("regret"), F.avg("switches").alias("mean_switches"))
