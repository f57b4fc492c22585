"""What waits in a stream costs a key one row of state, whatever its tokens, and is taken in its turn."""

from tests.test_streaming import run_stream
from tidemark.streaming.segmentation import segment


def test_early_tokens_of_several_batches_are_one_row_of_state(spark, tmp_path):
    words = [f"w{n}. " if n % 7 == 6 else f"w{n} " for n in range(60)]
    rows = [{"key": "a", "n": n, "token": t, "eos": n == 59} for n, t in enumerate(words)]
    got, progress = run_stream(spark, tmp_path, [rows[40:], rows[1:20], rows[20:40], rows[:1]], "waiting", schema="key string, n bigint, token string, eos boolean")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["numInputRows"]]
    assert held == [1, 1, 1, 0]
    want = segment(spark.createDataFrame([("a", words)], "key string, tokens array<string>"), eos=True).collect()
    assert sorted(tuple(r)[1:7] for r in got) == sorted(tuple(r)[1:7] for r in want) and len(got) > 5
