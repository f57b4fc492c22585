"""Boundary segmentation of token streams: a fold over arrays, and the same as a stateful stream.

A boundary is cut where at least ``min_tokens`` tokens have come since the last one and the text since then (its last 128
characters) ends in a boundary kind, and at the end of a sequence. After a closing tag, in any case and wherever it stands
in the text, the answer zone begins. Once the thinking budget is spent the zone is closed by force: the tokens that close
it are put into the sequence before the next one, or, without any, the zone changes as it is. At most ``max_boundaries``
are cut in a sequence, and at most ``max_switches`` of them may switch the mode.
"""

from __future__ import annotations

import io
import json
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.text import SENTENCE_ENDS, STEP_MARKS
from tidemark.operators.replay import choose_action

# Fixed value: the tag that ends reasoning.
CLOSE = "</think>"

#: Kinds in the order in which they are looked for: name, and test of the text, its stripped form and that in lower case.
KINDS = (
    ("newline", lambda text, s, low: "\n" in text),
    ("punct", lambda text, s, low: s.endswith(SENTENCE_ENDS)),
    ("step_marker", lambda text, s, low: any(a in low and b in low[-24:] for a, b in STEP_MARKS)),
)


def kind_of(text: str) -> str:
    """The boundary kind that a text ends in; empty if none."""
    s = text.rstrip()
    low = s.lower()
    return next((name for name, test in KINDS if test(text, s, low)), "")


@dataclass
class Segmenter:
    """State of one sequence; a few numbers and 136 characters, whatever its length."""

    min_tokens: int = 6
    max_boundaries: int = 80
    budget: int = 1 << 30
    tokens: int = 0
    since: int = 0
    cut: int = 0
    tail: str = ""
    closing: str = ""
    answer: bool = False
    think_used: int = 0
    answer_used: int = 0

    def _take(self, token: str) -> None:
        self.tokens += 1
        self.since += 1
        self.answer_used += self.answer
        self.think_used += not self.answer
        self.tail = (self.tail + token)[-128:]
        if not self.answer:
            seen = self.closing + token.lower()
            self.answer = CLOSE in seen
            self.closing = seen[1 - len(CLOSE) :]

    def _cut(self, end: bool = False) -> list[dict]:
        kind = "eos" if end else kind_of(self.tail) if self.since >= self.min_tokens else ""
        if not kind or self.cut >= self.max_boundaries:
            return []
        out = {
            "boundary_index": self.cut, "token_index": self.tokens, "boundary_kind": kind, "is_answer_zone": self.answer,
            "think_used": self.think_used, "answer_used": self.answer_used,
        }
        self.cut, self.since, self.tail = self.cut + 1, 0, ""
        return [out]

    def feed(self, token: str, end: bool = False, closers: Sequence[str] = ()) -> list[dict]:
        """Take a token, and before it what closes the zone by force; the boundaries they complete."""
        out = []
        if closers and not self.answer and self.think_used >= self.budget:
            for forced in closers:
                self._take(forced)
            out += self._cut()  # none is cut before the last of them
        self._take(token)
        if not closers and self.think_used >= self.budget:
            self.answer = True
        return out + self._cut(end)

    def push(self, token: str) -> dict | None:
        """Take a token; the boundary it completes, if any."""
        return next(iter(self.feed(token)), None)


_OUT = "key string, boundary_index int, token_index int, boundary_kind string, is_answer_zone boolean, think_used int, answer_used int"
_COLUMNS = [x.split()[0] for x in _OUT.split(", ")]


def segment(sequences: DataFrame, budget: int = 1 << 30, closers: Sequence[str] = (), eos: bool = False) -> DataFrame:
    """``(key string, tokens array<string>)`` to boundaries; sequences are independent, so nothing is shuffled.

    ``eos``: the last token of a sequence is its end. A null or empty sequence has no boundary.
    """
    closers = tuple(closers)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, tokens in zip(frame["key"], frame["tokens"], strict=True):
                s = Segmenter(budget=budget)
                tokens = () if tokens is None else tokens
                for n, token in enumerate(tokens, 1):
                    rows += [{"key": key, **b} for b in s.feed(token, eos and n == len(tokens), closers)]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return sequences.select("key", "tokens").mapInPandas(run, _OUT)


# Fixed value: the state store that keeps its rows outside the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "min_tokens int, max_boundaries int, budget bigint, tokens int, since int, cut int, tail string, closing string, answer boolean, think_used int, answer_used int, next bigint, action int, switches int, lowest bigint, early binary"
_STREAM_ROW = "struct<" + ", ".join(x.replace(" ", ": ") for x in [*_OUT.split(", ")[1:], "action int", "switches int"]) + ">"


def _sequence_fold(rule: dict) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Feeds a key's tokens in the order of ``n``; what comes early waits in the key's state until its turn.

    State travels with the tokens, many keys in a batch: a call of the state store, or a frame of its own for its
    boundaries, would cost each key milliseconds. What waits is packed as a list of lists, one for each batch that had
    such tokens, and read only if its lowest ``n`` is due.
    """

    def feed(held: list, token: str, eos: bool, scores, rows: list[dict]) -> None:
        s, _, action, switches = held
        for boundary in s.feed(token, bool(eos), rule["closers"]):
            if scores is not None and len(scores):
                left = rule["budgets"][action % len(rule["budgets"])] - s.think_used
                best = choose_action(list(scores), action, left, s.answer, rule["budgets"])
                if best != action and switches < rule["max_switches"]:
                    action, switches = best, switches + 1
            rows.append({**boundary, "action": action, "switches": switches})
        held[1:] = [held[1] + 1, action, switches]

    def told(key: str | None, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame({"key": [key], "told": [json.dumps(rows)]})

    def unpacked(packed: bytes) -> Iterator[tuple]:
        rest = io.BytesIO(packed)
        while rest.tell() < len(packed):
            yield from pickle.load(rest)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            *own, following, action, switches, lowest, packed = state.get
            held, packed = [Segmenter(*own), following, action, switches], bytes(packed)
        else:
            held, lowest, packed = [Segmenter(budget=rule["budget"]), rule["first"], rule["start"], 0], None, b""
        out: list[dict] = []
        if state.hasTimedOut:  # no token has come: take what waits, gaps left out, and forget the sequence
            waiting = {r[0]: r for r in unpacked(packed)}
            for n in sorted(k for k in waiting if k >= held[1]):
                held[1] = n
                feed(held, *waiting[n][1:], out)
            state.remove()
            yield from told(key[0], out)
            return
        early: dict[int, tuple] = {}  # of these rows
        ended = False

        def take() -> None:
            nonlocal ended
            while not ended and held[1] in early:
                n, token, eos, scores = early.pop(held[1])
                feed(held, token, eos, scores, out)
                ended = bool(eos)

        for frame in frames:
            for row in json.loads("[" + ",".join(frame["packed"].tolist()) + "]"):
                if (n := row["n"]) >= held[1]:  # else it has been taken before
                    scores = row.get("scores")
                    early[n] = (n, row.get("token"), row.get("eos", False), scores and [float(x) for x in scores])
            take()
        if not ended and lowest is not None and lowest <= held[1]:
            early = {r[0]: r for r in unpacked(packed) if r[0] >= held[1]} | early
            take()
            lowest, packed = None, b""
        if not ended:
            if early:
                lowest = min(early) if lowest is None else min(lowest, *early)
                packed += pickle.dumps([*early.values()])
            state.update((*vars(held[0]).values(), *held[1:], lowest, packed))
            state.setTimeoutDuration(rule["timeout_ms"])
        elif state.exists:
            state.remove()
        yield from told(key[0], out)

    return run


def segment_stream(
    tokens: DataFrame, budget: int = 1 << 30, closers: Sequence[str] = (), first: int = 0, timeout_ms: int = 600_000,
    budgets: Sequence[float] = (0, 64, 128, 256, 512), start: int = 0, max_switches: int = 8,
) -> DataFrame:
    """A stream of ``(key string, n bigint, token string)`` to boundaries, whatever order the tokens come in.

    ``n`` counts a sequence's tokens from ``first`` on. A token that comes before its turn waits; one that has been taken
    is dropped. With ``eos boolean``, a token for which it is true ends its sequence, and the state goes. A sequence that
    gets no token for ``timeout_ms`` is taken to its end with what waits, and its state goes too. With ``scores
    array<double>``, the joint action scores at each token, a boundary also has the ``action`` that the policy takes (see
    :func:`choose_action`) and the ``switches`` so far.
    """
    spark = tokens.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    own = set(tokens.columns)
    token = F.struct(
        F.col("n").cast("bigint").alias("n"), "token", *([F.col("eos")] if "eos" in own else []),
        *([F.col("scores").cast("array<double>").alias("scores")] if "scores" in own else []),
    )
    rows = tokens.where("n is not null").select("key", F.to_json(token).alias("packed"))  # each column would cost each key
    rule = {"budget": budget, "closers": tuple(closers), "first": first, "timeout_ms": timeout_ms, "budgets": tuple(budgets), "start": start, "max_switches": max_switches}
    cut = rows.groupBy("key").applyInPandasWithState(_sequence_fold(rule), "key string, told string", _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return cut.select("key", F.inline(F.from_json("told", f"array<{_STREAM_ROW}>")))


def decide(boundaries: pd.DataFrame, scores: list[list[float]], start: int, max_switches: int = 8) -> list[int]:
    """Action after each boundary: the best-scored one while switches are left."""
    at, left, out = start, max_switches, []
    for row in scores[: len(boundaries)]:
        best = max(range(len(row)), key=row.__getitem__)
        if best != at and left:
            at, left = best, left - 1
        out.append(at)
    return out


def decisions(boundaries: DataFrame, scores: Column, start: int = 0, max_switches: int = 8, key: str = "key") -> DataFrame:
    """``(key, boundary_index, action, switches)``: the action after each boundary, and the switches made so far.

    At a boundary the best-scored action is taken, the first one where equal, while switches are left. A sequence has
    ``max_boundaries`` rows at most, which are folded in one array.
    """
    kind = "struct<at:int,n:int,out:array<struct<boundary_index:int,action:int,switches:int>>>"
    best = (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
    rows = boundaries.select(key, "boundary_index", best.alias("best")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("boundary_index", "best"))).alias("rows"))
    begin = F.struct(F.lit(start).alias("at"), F.lit(0).alias("n"), F.expr("cast(array() as array<struct<boundary_index:int,action:int,switches:int>>)").alias("out")).cast(kind)

    def step(acc: Column, row: Column) -> Column:
        moves = (row["best"] != acc["at"]) & (acc["n"] < max_switches)
        at, n = F.when(moves, row["best"]).otherwise(acc["at"]), acc["n"] + F.when(moves, 1).otherwise(0)
        return F.struct(at.alias("at"), n.alias("n"), F.concat(acc["out"], F.array(F.struct(row["boundary_index"], at.alias("action"), n.alias("switches")))).alias("out")).cast(kind)

    folded = rows.select(key, F.aggregate("rows", begin, step, lambda a: a["out"]).alias("out"))
    return folded.select(key, F.inline("out"))


def policy_decisions(
    boundaries: DataFrame, scores: Column, budgets: Sequence[float], start: int = 0, max_switches: int = 8, key: str = "key",
    hysteresis: float = 0.05, switch_cost: float = 0.1, guardrail: float = 0.35,
) -> DataFrame:
    """``(key, boundary_index, action, switches)`` by the policy's terms, as :func:`choose_action` states them.

    ``boundaries(key, boundary_index, think_used, is_answer_zone)``. Staying has a bonus, switching a cost, and so has a
    budget beyond what the current action's leaves; in the answer zone info modes compete by their means, and the budget
    level stays. A sequence has ``max_boundaries`` rows at most, which are folded in one array.
    """
    n = len(budgets)
    listed = F.array(*[F.lit(float(b)) for b in budgets])
    row = F.struct("boundary_index", F.col("think_used").alias("used"), F.col("is_answer_zone").alias("answer"), F.transform(scores, lambda x: x.cast("double")).alias("scores"))
    rows = boundaries.select(key, row.alias("r")).groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    kind = "struct<at:int,n:int,out:array<struct<boundary_index:int,action:int,switches:int>>>"
    begin = F.struct(F.lit(start).alias("at"), F.lit(0).alias("n"), F.expr("cast(array() as array<struct<boundary_index:int,action:int,switches:int>>)").alias("out")).cast(kind)
    first_best = lambda a: F.array_position(a, F.array_max(a)) - 1

    def think(row: Column, at: Column) -> Column:
        left = F.get(listed, at % n) - row["used"]
        cost = lambda i: F.when(F.get(listed, (i % n).cast("int")) > left, F.lit(guardrail)).otherwise(F.lit(0.0))
        return first_best(F.transform(row["scores"], lambda x, i: x + F.when(i == at, F.lit(hysteresis)).otherwise(F.lit(-switch_cost)) - cost(i)))

    def answer(row: Column, at: Column) -> Column:
        infos = F.sequence(F.lit(0), (F.size(row["scores"]) / n).cast("int") - 1)
        mean = lambda k: F.aggregate(F.slice(row["scores"], k * n + 1, n), F.lit(0.0), lambda s, x: s + x) / n
        rated = F.transform(infos, lambda k: mean(k) + F.when(k == F.floor(at / n), F.lit(hysteresis)).otherwise(F.lit(-switch_cost)))
        return first_best(rated) * n + at % n

    def step(acc: Column, row: Column) -> Column:
        best = F.when(row["answer"], answer(row, acc["at"])).otherwise(think(row, acc["at"])).cast("int")
        made = F.transform(F.array(best), lambda b: F.struct(F.when((b != acc["at"]) & (acc["n"] < max_switches), b).otherwise(acc["at"]).alias("at"), F.when((b != acc["at"]) & (acc["n"] < max_switches), 1).otherwise(0).alias("moved")))
        now = F.get(made, F.lit(0))
        return F.struct(now["at"].alias("at"), (acc["n"] + now["moved"]).alias("n"), F.concat(acc["out"], F.array(F.struct(row["boundary_index"].alias("boundary_index"), now["at"].alias("action"), (acc["n"] + now["moved"]).alias("switches")))).alias("out")).cast(kind)

    folded = rows.select(key, F.aggregate("rows", begin, step, lambda a: a["out"]).alias("out"))
    return folded.select(key, F.inline("out"))
