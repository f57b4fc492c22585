"""Sequence, matching, slot and network queries against plain Python over the smallest tables or random cases."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import vectors as V
from tidemark.operators import replay, slots
from tidemark.operators.ordering import dense_index, exact_median
from tidemark.sources import artifacts, config
from tidemark.sources.files import relabel, scratch, write_jsonl
from tidemark.streaming.segmentation import decide, decisions, segment

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def kind(text):
    """Kind of a boundary, by the rules as they are stated."""
    if "\n" in text:
        return "newline"
    s = text.rstrip()
    if s and s[-1] in ".?!。？！:：":
        return "punct"
    low = s.lower()
    return "step_marker" if ("step " in low and ":" in low[-24:]) or "reasoning:" in low[-24:] else ""


def plain_segments(tokens, budget=1 << 30, closers=(), eos=False):
    """Each token with the whole text so far, instead of carried tails."""
    taken, forced = [], []
    out, last, zone, think, answer, tail = [], 0, False, 0, 0, ""

    def take(token):
        nonlocal zone, think, answer, tail
        taken.append(token)
        tail += token
        if zone:
            answer += 1
        else:
            think += 1
        zone = zone or "</think>" in "".join(taken).lower()

    def cut(end):
        nonlocal last, tail
        name = "eos" if end else kind(tail[-128:]) if len(taken) - last >= 6 else ""
        if name and len(out) < 80:
            out.append((len(out), len(taken), name, zone, think, answer))
            last, tail = len(taken), ""

    for n, token in enumerate(tokens):
        if closers and not zone and think >= budget:
            for c in closers:
                take(c)
                forced.append(c)
            cut(False)
        take(token)
        if not closers and think >= budget:
            zone = True
        cut(eos and n == len(tokens) - 1)
    return out


def test_segments_match_whole_text_reading(spark):
    rng = random.Random(3)
    pieces = ["a ", "b", " c.", "\n", "Step 2", ": go ", "</thi", "nk>", "</Think>\n", "reasoning:", "。", " d?", "e! "]
    rows = [(str(k), [rng.choice(pieces[:6] if k % 2 else pieces) for _ in range(rng.choice([0, 1, 5, 40, 700]))]) for k in range(60)] + [("none", None)]
    frame = spark.createDataFrame(rows, "key string, tokens array<string>")
    for budget, closers, eos in ((1 << 30, (), True), (25, (), False), (25, ("\n", "</think>", " FINAL "), True)):
        want = {(k, *b) for k, t in rows for b in plain_segments(t or [], budget, closers, eos)}
        got = {tuple(r) for r in segment(frame, budget, closers, eos).collect()}
        assert got == want and len(want) > 100


def test_decisions_match_the_fold(spark):
    rng = random.Random(4)
    rows = [(f"k{k}", b, [rng.randrange(4) * 1.0 for _ in range(5)]) for k in range(20) for b in range(rng.randrange(1, 40))]
    got = decisions(spark.createDataFrame(rows, "key string, boundary_index int, scores array<double>"), F.col("scores"), start=2).collect()
    for k in {r[0] for r in rows}:
        mine = [r[2] for r in rows if r[0] == k]
        want = decide([0] * len(mine), mine, 2)
        assert [r.action for r in sorted((g for g in got if g.key == k), key=lambda g: g.boundary_index)] == want
        assert max(g.switches for g in got if g.key == k) == sum(a != b for a, b in zip([2, *want], want, strict=False)) <= 8


def plain_walk(actions, start, budgets):
    """The stored-trace walk, spelt out."""
    def weight(a, b):
        if a["answer"] != b["answer"]:
            return 0.0
        d = sum(abs(x - y) for x, y in zip(a["features"], b["features"], strict=True)) + sum(p for p, x, y in zip(a["penalties"], a["marks"], b["marks"], strict=True) if x != y)
        w = math.exp(-d / 0.75)
        return w if w >= 1e-4 else 0.0

    def policy(row, current):
        n = len(budgets)
        if row["answer"]:
            best = max(range(4), key=lambda i: (sum(row["scores"][i * n : i * n + n]) / n + (0.05 if i == current // n else -0.1), -i))
            return best * n + current % n
        return max(range(4 * n), key=lambda k: (row["scores"][k] + (0.05 if k == current else -0.1) - (0.35 if budgets[k % n] > row["remaining"] else 0), -k))

    at = start if start in actions else min(actions)
    rows, pos, switches = actions[at]["rows"], 0, 0
    if not rows:
        return at, 0, actions[at]["token_count"]
    used = rows[0]["generated"]
    for _ in range(max(8, 2 * max(len(a["rows"] or []) for a in actions.values()))):
        row = rows[pos]
        to = policy(row, at)
        if to != at:
            if switches >= 8:
                break
            target = actions.get(to, {}).get("rows")
            if target:
                near = [k for k, x in enumerate(target) if x["progress"] + 0.03 >= row["progress"]]
                weights = {k: weight(row, target[k]) for k in near}
                if near:
                    top = max(round(w, 8) for w in weights.values())
                    pos = min((k for k in near if round(weights[k], 8) == top), key=lambda k: (abs(target[k]["progress"] - row["progress"]), k))
                else:
                    pos = 0
                at, rows, switches = to, target, switches + 1
                used = max(used, rows[pos]["generated"])
                continue
        if pos + 1 >= len(rows):
            break
        pos += 1
        used = max(used, rows[pos]["generated"])
    return at, switches, used + max(0, actions[at]["token_count"] - rows[pos]["generated"])


@needs_tables
def test_replay_walks_match_plain_walks(spark):
    from tidemark.plans.vector_queries import BUDGETS, walk_states

    states = walk_states(spark, SF)
    problems = {}
    for r in states.collect():
        problems.setdefault((r.dataset, r.problem_id), {})[r.action] = r.asDict(recursive=True)
    got = {(r.dataset, r.problem_id): (r.action, r.switches, r.token_count) for r in replay.replay_walks(states, BUDGETS).collect()}
    want = {k: plain_walk(a, 6, BUDGETS) for k, a in problems.items()}
    assert got == want and len({w[1] for w in want.values()}) > 1


def test_matches_fall_back(spark):
    rows = [(1, 0, 0.5, 2, 0, 0.2, 0.9), (1, 0, 0.5, 2, 1, 0.6, 0.0), (1, 0, 0.5, 2, 2, 0.55, 0.0), (1, 0, 0.5, 3, 0, 0.1, 0.9), (1, 0, 0.5, 3, 1, 0.2, 0.9), (1, 0, 0.5, 4, 0, 0.48, 0.3), (1, 0, 0.5, 4, 1, 0.9, 0.3), (1, 0, 0.5, 4, 2, 0.9, 0.2)]
    pairs = spark.createDataFrame(rows, "a int, b int, anchor_progress double, t int, ix int, progress double, weight double")
    assert {r.t: r.matched for r in replay.match_rows(pairs, ["a", "b"], ["t"], "ix").collect()} == {2: 2, 3: 0, 4: 0}


@needs_tables
def test_slots_match_numpy(spark):
    from tidemark.plans import catalog

    run = lambda name: {r[0]: r[1] for r in catalog.queries()[name](spark, SF).collect()}
    rows = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    centres = np.array([v for _, v in sorted(run("VEC7").items())])
    assert np.allclose(np.linalg.norm(centres, axis=1), 1)
    unit = {k: v / max(1e-8, np.linalg.norm(v)) for k, v in rows.items()}
    soft = lambda x, t: (e := np.exp((x - x.max()) / t)) / max(1e-8, e.sum())
    near = {k: int((centres @ u).argmax()) for k, u in unit.items()}
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    sims = frame.select("vec_id", slots.similarities(F.col("embedding"), centres).alias("s")).collect()
    assert all(np.allclose(r.s, centres @ unit[r.vec_id]) for r in sims)
    shares = {k: soft(v[:20], 0.25) for k, v in rows.items()}
    given = frame.select("embedding", V.softmax(F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 20), 0.25).alias("d"), F.lit(2.0).alias("w"))
    priors = {r.slot: np.array(r.prior) for r in slots.slot_priors(given, "embedding", "d", "w", centres).collect()}
    assert set(priors) == set(range(len(centres)))
    own = lambda j: [shares[k] for k in rows if near[k] == j] or [*shares.values()]
    assert all(np.allclose(p, soft(np.mean(own(j), axis=0), 1.0), atol=1e-9) for j, p in priors.items())
    table = np.array([priors[j] for j in range(len(centres))])
    for r in frame.select("vec_id", slots.query_slots(F.col("embedding"), centres, table.tolist()).alias("p")).collect():
        assert np.allclose(r.p, soft(centres @ unit[r.vec_id], 0.35) @ table, atol=1e-9)


def test_artifact_round_trip(spark):
    made = artifacts.Artifact([0, 64], np.eye(3), np.full((3, 20), 0.05), 0.4, {"kinds": ["a"]}, networks={"prior": [(np.ones((2, 2)), np.zeros(2))]})
    path = scratch(spark, "artifact")
    artifacts.write_artifact(spark, made, path)
    found = artifacts.read_artifact(spark, path)
    assert (found.budgets, found.temperature, found.spec, found.kernel) == (made.budgets, made.temperature, made.spec, made.kernel)
    assert np.array_equal(found.centres, made.centres) and np.array_equal(found.networks["prior"][0][0], np.ones((2, 2)))
    assert slots.mlp_scores(spark.createDataFrame([(1, [1.0, 2.0])], "k int, x array<double>"), "x", found.networks["prior"], ["k"]).collect()[0].logits == [3.0, 3.0]


def test_configurations(tmp_path):
    (tmp_path / "c.yaml").write_text("a: 1\n")
    (tmp_path / "c.json").write_text("")
    (tmp_path / "list.json").write_text("[1]")
    assert config.load_config(tmp_path / "c.yaml") == {"a": 1} and config.load_config(tmp_path / "c.json") == {}
    with pytest.raises(ValueError):
        config.load_config(tmp_path / "list.json")
    assert config.merged({"a": 1, "b": 2}, {"b": 3}, {"a": None, "c": 4}) == {"a": 1, "b": 3, "c": 4}
    with pytest.raises(ValueError):
        config.merged({}, {}, {"x": ""}, ["x"])
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "d.jsonl").write_text("")
    assert config.dataset_path(tmp_path / "c.yaml", tmp_path / "data", "d.jsonl") == (tmp_path / "data" / "d.jsonl").resolve()
    assert config.dataset_path(tmp_path / "c.yaml", tmp_path / "data", "e.jsonl") == (tmp_path / "e.jsonl").resolve()
    assert config.for_split({"a": {"source": "x", "limit": 5, "offset": 2}}, {"a": "y"}) == {"a": {"source": "y", "limit": None, "offset": 2}}
    assert config.by_number({"1": 4}, 1) == config.by_number({1: 4}, 1) == 4
    assert [config.duration_text(x) for x in (-1, 4.25, 187, 7509)] == ["0.0s", "4.2s", "3m07s", "2h05m09s"]


def test_places_have_no_gap(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc") if k % 7 else None, rng.randrange(50), k) for k in range(500)]
    frame = spark.createDataFrame(rows, "g string, v int, k int").repartition(5)
    got = dense_index(frame, ["v", "k"], ["g"], start=1).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r.v, r.k, r.place) for r in got if r.g == g)
        assert [m[2] for m in mine] == list(range(1, len(mine) + 1))
    assert sorted((r.v, r.k, r.place) for r in dense_index(frame, ["v", "k"]).collect()) == [(v, k, n) for n, (v, k) in enumerate(sorted((r[1], r[2]) for r in rows))]
    assert dense_index(frame.limit(0), ["v"]).count() == 0
    assert exact_median(frame, F.col("v")).first()[0] == float(np.median([r[1] for r in rows]))
    assert exact_median(frame.limit(0), F.col("v")).first()[0] is None


def test_relabel_in_place_and_aside(spark):
    path = scratch(spark, "rows")
    write_jsonl(spark.createDataFrame([(1, 0), (2, 0)], "k int, v int"), path)
    change = lambda rows: rows.withColumn("v", F.col("k") * 10)
    assert relabel(spark, path, change, "k int, v int", aside=f"{path}-new") == f"{path}-new"
    assert relabel(spark, path, change, "k int, v int") == path
    for p in (path, f"{path}-new"):
        assert {tuple(r) for r in spark.read.schema("k int, v int").json(p).collect()} == {(1, 10), (2, 20)}


def test_training_matches_one_process(spark):
    from tidemark.operators import training

    rng = np.random.default_rng(1)
    n, sizes = 90, [6, 8, 7, 4]
    x, w = rng.normal(size=(n, 6)), rng.uniform(0.5, 2, n)
    target = np.exp(x[:, :4] * 2)
    target /= target.sum(axis=1, keepdims=True)
    pairs = [[(int(a), int(b), float(rng.uniform(0.5, 1))) for a, b in [rng.permutation(4)[:2]]] if k % 3 else [] for k in range(n)]
    frame = spark.createDataFrame([(x[k].tolist(), target[k].tolist(), float(w[k]), pairs[k]) for k in range(n)], "x array<double>, target array<double>, weight double, pairs array<struct<winner_index:int,loser_index:int,weight:double>>").repartition(3)
    start = training.new_network(sizes)
    listed = np.array([(k, *p) for k in range(n) for p in pairs[k]])
    scaled = listed * [1, 1, 1, 0.5 / listed[:, 3].sum()]

    def loss_of(flat):
        return training.gradients(training._shaped(flat, start), x, target, w / w.sum(), scaled)[1]

    flat = training._flat(start)
    g, _ = training.gradients(start, x, target, w / w.sum(), scaled)
    for k in rng.choice(len(flat), 25, replace=False):  # against differences
        d = np.zeros_like(flat)
        d[k] = 1e-6
        assert abs((loss_of(flat + d) - loss_of(flat - d)) / 2e-6 - g[k]) < 1e-6
    made, losses = training.train_network(frame, start, pairs="pairs", epochs=4, lr=0.01)
    m, v, want = np.zeros_like(flat), np.zeros_like(flat), flat.copy()
    for k in range(1, 5):
        g, loss = training.gradients(training._shaped(want, start), x, target, w / w.sum(), scaled)
        assert abs(losses[k - 1] - loss) < 1e-9
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        want = want * (1 - 0.01 * 1e-4) - 0.01 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    assert np.allclose(training._flat(made), want, atol=1e-9) and losses[-1] < losses[0]
    assert training.train_network(frame.limit(0), start)[0] is start


def test_hashed_text_matches_token_by_token(spark):
    import hashlib
    import re

    texts = [None, "", " ", "a", "ab cd", "É à la carte!  Ünï\tcode\xa0x", "日本語 🙂🙂🙂 ok_1", "the the the cat, sat. " * 30, "x" * 50]
    got = {r.k: (r.c, r.v) for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", V.hashed_counts(F.col("t"), 32).alias("c"), V.hashed_vector(F.col("t"), 32).alias("v")).collect()}
    for k, text in enumerate(texts):
        low = (text or "").lower()
        compact = re.sub(r"\s+", " ", low).strip()
        tokens = [f"w:{w}" for w in re.findall(r"\w+|[^\w\s]", low)] + [f"c{n}:{compact[i : i + n]}" for n in (3, 4, 5) for i in range(len(compact) - n + 1)]
        want = np.bincount([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 32 for t in tokens], minlength=32) if tokens else np.zeros(32)
        assert np.array_equal(got[k][0], want) and np.allclose(got[k][1], want / max(1e-8, np.linalg.norm(want)))
