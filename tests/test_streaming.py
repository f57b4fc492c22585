"""The stateful stream cuts where the fold does, whatever the batches and the order of tokens, and keeps no state."""

import json
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators.replay import choose_action
from tidemark.streaming.segmentation import Segmenter, decide, policy_decisions, segment, segment_stream

BUDGETS = (0, 64, 128, 256, 512)


def run_stream(spark, tmp_path, parts, name, schema="key string, n bigint, token string, eos boolean, scores array<double>", **how):
    source = tmp_path / f"in-{name}"
    source.mkdir()
    for k, rows in enumerate(parts):
        (source / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(source / f"{k}.json", (1_700_000_000 + 60 * k,) * 2)  # files are taken in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(source))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timers would ask for batches without end
    writer = segment_stream(stream, **how).writeStream.format("memory").queryName(name).outputMode("append")
    run = writer.option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    run.awaitTermination(240)
    return spark.table(name).collect(), run.recentProgress


def test_stream_equals_fold_for_any_order(spark, tmp_path):
    rng = random.Random(8)
    words = ["x ", "end.\n", "y ", "so.", "q. ", "</think>", "Step 2: "]
    tokens = {f"k{i}": [rng.choice(words) for _ in range(rng.randrange(1, 60))] for i in range(12)}
    rows = [{"key": k, "n": n, "token": t, "eos": n == len(ts) - 1, "scores": [rng.randrange(8) / 8 for _ in range(20)]} for k, ts in tokens.items() for n, t in enumerate(ts)]
    dealt = rows + rng.sample(rows, 20)  # some come twice
    rng.shuffle(dealt)
    parts = [dealt[k::3] for k in range(3)]
    got, progress = run_stream(spark, tmp_path, parts, "cuts", budget=30, closers=("\n", "</think>"))
    fold = segment(spark.createDataFrame(list(tokens.items()), "key string, tokens array<string>"), budget=30, closers=("\n", "</think>"), eos=True).collect()
    assert {tuple(r)[:7] for r in got} == {tuple(r) for r in fold} and len(got) == len(fold) > 30
    scores = {(r["key"], r["n"]): r["scores"] for r in rows}
    for key, ts in tokens.items():
        s, at, switches, want = Segmenter(budget=30), 0, 0, []
        for n, t in enumerate(ts):
            for _ in s.feed(t, n == len(ts) - 1, ("\n", "</think>")):
                best = choose_action(scores[key, n], at, BUDGETS[at % 5] - s.think_used, s.answer, BUDGETS)
                if best != at and switches < 8:
                    at, switches = best, switches + 1
                want.append((at, switches))
        assert [(r.action, r.switches) for r in sorted((r for r in got if r.key == key), key=lambda r: r.boundary_index)] == want
    # what is left are repeats that came behind their sequence's end
    late = progress[-1]["stateOperators"][0]["numRowsTotal"]
    assert late <= 4 * 20


def test_state_goes_at_the_end_and_by_timer(spark, tmp_path):
    ended = [{"key": "a", "n": n, "token": "x.", "eos": n == 9} for n in range(10)]
    got, progress = run_stream(spark, tmp_path, [ended[5:], ended[:5]], "ended")
    assert [r.boundary_index for r in got] == [0, 1] and progress[-1]["stateOperators"][0]["numRowsTotal"] == 0
    open_ = [{"key": "b", "n": n, "token": "x."} for n in (0, 1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 13)]
    other = [{"key": "c", "n": n, "token": "y", "eos": n == 1} for n in range(2)]
    got, progress = run_stream(spark, tmp_path, [open_, other], "timer", timeout_ms=1)
    assert sorted((r.key, r.boundary_index, r.token_index) for r in got) == [("b", 0, 6), ("b", 1, 12), ("c", 0, 2)]
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_policy_decisions_match_a_loop(spark):
    rng = random.Random(4)
    rows = [(f"k{k}", b, rng.randrange(400), rng.random() < 0.3, [rng.randrange(6) / 8 for _ in range(20)]) for k in range(15) for b in range(rng.randrange(1, 30))]
    frame = spark.createDataFrame(rows, "key string, boundary_index int, think_used int, is_answer_zone boolean, scores array<double>").repartition(4)
    got = {(r.key, r.boundary_index): (r.action, r.switches) for r in policy_decisions(frame, F.col("scores"), BUDGETS, start=7).collect()}
    state = {}
    for key, b, used, zone, scores in rows:
        at, switches = state.get(key, (7, 0))
        best = choose_action(scores, at, BUDGETS[at % 5] - used, zone, BUDGETS)
        if best != at and switches < 8:
            at, switches = best, switches + 1
        state[key] = at, switches
        assert got[key, b] == (at, switches)
    assert len(got) == len(rows) and max(s for _, s in got.values()) == 8


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
def test_registered_stream_equals_registered_fold(spark):
    from tidemark.plans import vector_queries as Q

    sf = "/root/testdata/sf0.001"
    fold = segment(Q._tokens(spark, sf), budget=40, closers=Q.CLOSERS, eos=True)
    assert {tuple(r) for r in Q.seq1_stream(spark, sf).collect()} == {tuple(r) for r in fold.collect()}


def test_limits():
    s = Segmenter(min_tokens=1, max_boundaries=2)
    assert sum(s.push("a.") is not None for _ in range(9)) == 2
    assert decide([0] * 4, [[0, 1], [1, 0], [0, 1], [1, 0]], 0, max_switches=2) == [1, 0, 0, 0]
