"""Whitening against exact fractions and a plain eigenproblem."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, components=4):
    """Per row with whole entries: id, exact deviation, centred vector; and the eigenvalues of the exact covariance."""
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(dims)]
    centred = [[Fraction(x[k] * n - sums[k], n) for k in range(dims)] for x in fit]
    cov = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums)), np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums)]) @ vectors / np.sqrt(np.maximum(values, 1e-300))) for i, x in good]
    return n, out, values / np.trace(cov)


def test_whiten_matches_exact_fractions(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6)) * [9, 5, 3, 1, 0.5, 0.2] + [100, 0, -7, 0, 3, 0]
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)]
    rows += [(k + 500, rows[0][1]) for k in range(40)] + [(None, rows[3][1]), (7, rows[5][1]), (7, [-0.0] * 6), (8, [0.0] * 6)]
    broken = [(900, None), (901, []), (902, [1.0, None] * 3), (903, [math.nan] * 6), (904, [1.0] * 5 + [math.inf]), (905, [-math.inf] + [0.0] * 5)]
    frame = spark.createDataFrame(rows + broken, SCHEMA).selectExpr("*", "1 as x", "2 as n", "'a' as whitened").repartition(4)
    got = whitening.whiten(frame).collect()
    n, want, explained = plain(rows + broken)
    assert len(got) == len(rows) and {r.n for r in got} == {n}
    key = lambda i, d: (i is None, i or 0, d)
    got.sort(key=lambda r: key(r.vec_id, int(r.deviation)))
    want.sort(key=lambda w: key(w[0], w[1]))
    assert [(r.vec_id, int(r.deviation)) for r in got] == [w[:2] for w in want]
    a, b = np.array([r.whitened for r in got]), np.array([w[2] for w in want])
    signs = np.sign((a * b).sum(axis=0))
    assert np.abs(a * signs - b).max() < 1e-9
    assert np.allclose(got[0].explained, explained, rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_exact_deviations_of_large_entries():
    x = np.array([[2**62, -(2**63)], [2**63 - 1, 5], [-(2**61), 7]], dtype=np.int64)
    sums, n = [int(sum(map(int, c))) for c in x.T], 3
    assert whitening.deviations(x, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    small = np.array([[5, -3], [1, 2]], dtype=np.int64)
    assert whitening.deviations(small, 2, [6, -1]) == [sum((2 * int(c) - s) ** 2 for c, s in zip(row, [6, -1])) for row in small]
    assert np.allclose(whitening._centred(x, n, sums), [[float(Fraction(n * int(c) - s, n)) for c, s in zip(row, sums)] for row in x], rtol=1e-12)


def test_far_mean_and_small_spread(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(rng.normal(size=(300, 3)) * [0.1, 0.05, 0.02] + 1e9)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows])
    fit = np.array(sorted({tuple(r) for r in x.tolist()}))
    values = np.linalg.eigvalsh(np.cov((fit - fit[0]).T, bias=True))[::-1]
    assert np.allclose(got[0].explained, values / values.sum(), rtol=1e-9) and got[0].identity_error < 1e-9


def test_defined_results_without_spread(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whitening.whiten(frame([])).collect() == []
    assert whitening.whiten(frame([(1, None), (2, [])])).collect() == []
    one = whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, [None, None], [None, None], None)] * 2
    flat = whitening.whiten(frame([(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert [r.whitened[1] for r in flat] == [None, None] and sorted(abs(r.whitened[0]) for r in flat) == pytest.approx([1, 1])
    assert flat[0].explained == pytest.approx([1, 0]) and flat[0].identity_error < 1e-12
    with pytest.raises(ValueError, match="one length"):
        whitening.whiten(frame([(1, [1.0]), (2, [1.0, 2.0])]))


def test_query_holds_the_contract(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.queries()["op13_whitening"](spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, want, explained = plain(rows)
    found = {}
    for r in got:
        found.setdefault(r.vec_id, {})[r.component] = r
    assert len(found) == len(want) and all(sorted(f) == [1, 2, 3, 4] for f in found.values())
    signs = np.sign(sum(np.array([found[i][k].whitened for k in (1, 2, 3, 4)]) * w for i, _, w in want))
    for i, deviation, w in want:
        assert {r.deviation for r in found[i].values()} == {deviation} and {r.n for r in found[i].values()} == {n}
        assert np.allclose([found[i][k].whitened for k in (1, 2, 3, 4)], w * signs, atol=1e-9)
        assert np.allclose([found[i][k].explained for k in (1, 2, 3, 4)], explained, rtol=1e-9)
    assert max(r.identity_error for r in got) < 1e-9
