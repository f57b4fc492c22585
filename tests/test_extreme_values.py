"""Queries over long texts, near ties and halves, against their SQL in DuckDB."""

import pytest

from tidemark.plans import catalog

duckdb = pytest.importorskip("duckdb")


def differences(spark, folder, name, **tables):
    """Rows of the query and of its SQL, sorted, over the given frames."""
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    frame = catalog.queries()[name](spark, str(folder))
    got = sorted(map(repr, (tuple(x) for x in frame.collect())))
    want = sorted(map(repr, con.sql(f"select {', '.join(frame.columns)} from ({catalog.oracle_sql()[name]})").fetchall()))
    return got, want


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", ["STR12", "STR16"])
def test_products_of_a_long_texts_counts(spark, tmp_path, name):
    texts = ["a " * 50_000, "x" * 123_457, "b c " * 20_001, "d"]
    rows = [(k, texts[(k + k // 6) % len(texts)], "en", "s", 1) for k in range(30)]
    got, want = differences(spark, tmp_path, name, documents=spark.createDataFrame(rows, DOCUMENTS))
    assert got == want


def test_scores_on_a_half_round_as_in_sql(spark, tmp_path):
    # two events a problem; scores of six places times 0.15 stand on a half of the fourth place now and then
    rows = [(4 * k + j * 4000 + k % 4, 30 * k + j, ["view", "buy"][j % 2 if k % 5 else 0], float(11 + (k * 7919 + j * 104729) % 37)) for k in range(2000) for j in range(3)]
    events = spark.createDataFrame([(e, u // 30, t, v) for e, u, t, v in rows], "event_id bigint, user_id bigint, event_type string, value double")
    got, want = differences(spark, tmp_path, "VEC10", events=events)
    assert got == want


def test_rounding_scales_first(spark):
    from tidemark.functions.vectors import rounded

    values = [0.23834999999999998, -0.0040499999999999998, 2.5, -2.5, 0.49999999999999994, 1e300, None]
    got = [x.y for x in spark.createDataFrame([(v,) for v in values], "x double").select(rounded("x", 4).alias("y")).collect()]
    want = [x for x, in duckdb.connect().execute("select round(unnest(?::double[]), 4)", [values]).fetchall()]
    assert got == want and got[0] == 0.2384


def test_repeat_ratio_makes_the_tokens_once(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import vectors as V

    frame = spark.createDataFrame([("a b c " * 50,)], "t string").coalesce(1)
    ratio = frame.select(V.repeat_ratio(F.regexp_extract_all(F.upper("t"), F.lit("[A-Z]+"), F.lit(0))).alias("r"))
    plan = ratio._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert ratio.first().r == pytest.approx(123 / 126)


def test_weights_that_round_apart_are_no_tie(spark, monkeypatch):
    from tidemark.plans import vector_queries

    kind = "anchor_trace_id bigint, anchor_boundary_index int, anchor_progress_ratio double, candidate_trace_id bigint, candidate_boundary_index int, candidate_progress_ratio double, weight double"
    rows = [
        (1, 0, 0.2, 2, 0, 0.6, 0.123456786), (1, 0, 0.2, 2, 1, 0.4, 0.123456784),  # round to ...79 and ...78: the first
        (1, 0, 0.2, 3, 0, 0.6, 0.123456784), (1, 0, 0.2, 3, 1, 0.4, 0.123456779),  # both to ...78: the smaller gap
        (1, 0, 0.2, 4, 0, 0.1, 0.9), (1, 0, 0.2, 4, 1, 0.5, 0.0), (1, 0, 0.2, 4, 2, 0.3, 0.0),  # the first lies back
    ]
    monkeypatch.setattr(vector_queries.N, "neighbour_pairs", lambda *a, **k: spark.createDataFrame(rows, kind))
    monkeypatch.setattr(vector_queries, "boundary_samples", lambda *a: None)
    got = {r.candidate_trace_id: r.matched for r in catalog.queries()["JN10"](spark, "").collect()}
    assert got == {2: 0, 3: 1, 4: 2}


def test_numbers_of_many_digits_print_as_in_sql(spark, tmp_path):
    numbers = "12345678901234567890 99999999999999999999999 9223372036854775808 4111111111111111 123456789.5 98765432.125 0.00012345 0.00001 0.000000123 0.0005 -0.0 -7.25 1234567.25 12345678901234567890123456789012345678 9007199254740993 -18446744073709551617".split()
    rows = [(k, f"so it is {x} then", "en", "s", k * 3_000_000) for k, x in enumerate(numbers)] + [(99, None, "en", "s", 1), (98, "none", "en", "s", None)]
    got, want = differences(spark, tmp_path, "STR3", documents=spark.createDataFrame(rows, DOCUMENTS))
    assert got == want


def test_model_inputs_hash_a_text_once_a_trace(spark):
    from tidemark.plans import catalog

    plan = catalog.queries()["VEC8"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(k for k, line in enumerate(plan) if "ArrowEvalPython" in line)
    depth = plan[at].index("ArrowEvalPython")
    below = [line for line in plan[at + 1 :] if line.strip(" :+-")]
    until = next((k for k, line in enumerate(below) if len(line) - len(line.lstrip(" :+-")) <= depth), len(below))
    assert until and not any("l_orderkey" in line for line in below[:until])


def test_bucketed_neighbours_are_not_spread_before_the_shuffle(spark):
    from tidemark.plans import catalog

    plan = catalog.queries()["JN9"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan


def test_best_neighbours_use_the_shuffle_of_the_join(spark):
    from tidemark.plans import catalog

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are not small
    try:
        plan = catalog.queries()["AGG19"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [line for line in plan.split("\n") if "hashpartitioning" in line]
    assert dealt and not any("anchor_trace_id" in line.split("hashpartitioning")[1] for line in dealt)
