"""Columns of a user's table that are called as an operator's own."""

from tidemark.operators.splits import exact_split
from tidemark.sources.benchmarks import limited


def test_limits_and_splits_leave_columns_alone(spark):
    rows = spark.createDataFrame([(f"d{k % 2}", k) for k in range(20)], "dataset string, k int")
    named = rows.selectExpr("*", "k * 10 as place", "'r' as row", "'g' as `group`", "'o' as `order`", "'x' as digest_", "'y' as key", "'z' as digest")
    got = limited(named, "dataset", "k", {"d0": (1, 3), "d1": (0, None)}, {"d1": 2})
    assert got.columns == named.columns
    assert sorted((r.dataset, r.k, r.place, r.row) for r in got.collect()) == [("d0", 2, 20, "r"), ("d0", 4, 40, "r"), ("d0", 6, 60, "r"), ("d1", 1, 10, "r"), ("d1", 3, 30, "r")]
    split = exact_split(named, "dataset", "k", "s", {"train": 6, "test": 3})
    assert split.columns == [*named.columns, "split"]
    found = split.collect()
    assert sorted((r.dataset, r.split) for r in found) == sorted((d, s) for d in ("d0", "d1") for s in ["train"] * 6 + ["test"] * 3)
    assert all(r.place == 10 * r.k and r.digest_ == "x" for r in found)
    plain = {(r.k, r.split) for r in exact_split(rows, "dataset", "k", "s", {"train": 6, "test": 3}).collect()}
    assert plain == {(r.k, r.split) for r in found}
