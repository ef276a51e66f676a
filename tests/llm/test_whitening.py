import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from drawpool.llm import queries, whitening as W

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 64, 130])
def test_components_against_a_dense_solver(n):
    rng = np.random.default_rng(n)
    spectra = [np.sort(rng.random(n))[::-1], np.ones(n), np.r_[np.ones(min(n, 3)), np.full(max(0, n - 3), .5)], 10.0 ** -np.arange(n), np.r_[np.full(min(2, n), 5.0), np.zeros(max(0, n - 2))]]
    for lam in spectra:
        q = np.linalg.qr(rng.standard_normal((n, n)))[0]
        a = q @ np.diag(lam) @ q.T
        a = (a + a.T) / 2
        values, vectors = W.components(a, 4)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:len(values)]).max() < 1e-13 * lam[0]
        assert np.abs(a @ vectors.T - vectors.T * values).max() < 1e-13 * n * lam[0]
        assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-13
        assert len(values) == min(4, n, int((lam > 1e-12).sum()))


def test_special_matrices():
    for a, k in ((np.zeros((3, 3)), 0), (np.ones((6, 6)), 1), (np.diag([3.0, 3, 2, 1]), 4), (np.diag([1e-300, 0, 0]), 1)):
        values, vectors = W.components(a)
        assert len(values) == k and np.abs(vectors @ vectors.T - np.eye(k)).max(initial=0) < 1e-14


def test_sturm_counts():
    rng = np.random.default_rng(0)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    e[10] = 0
    true = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    x = np.linspace(-4, 4, 101)
    assert (W.sturm_count(d, e, x) == (true[None] < x[:, None]).sum(axis=1)).all()


def _check(rows, vectors):
    """rows of ``whiten`` against exact sums and a dense solver."""
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(map(tuple, x.values())))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit) - np.array(s) / n
    cov = centred.T @ centred / n
    lam = np.linalg.eigvalsh(cov)[::-1]
    k = min(4, len(s))
    assert sorted((r.vec_id, r.component) for r in rows) == [(i, c) for i in sorted(x) for c in range(1, k + 1)]
    got = {(r.vec_id, r.component): r for r in rows}
    assert {r.n for r in rows} == {n}
    for (i, _), r in got.items():
        assert r.deviation == sum((n * a - b) ** 2 for a, b in zip(x[i], s))
    for c in range(1, k + 1):
        assert abs(got[next(iter(x)), c].explained / (lam[c - 1] / lam.sum()) - 1) < 1e-9
    white = np.array([[got[next(i for i in x if tuple(x[i]) == f), c].whitened for c in range(1, k + 1)] for f in fit])
    error = np.abs(white.T @ white / n - np.eye(k)).max()
    assert error < 1e-9 and {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9
    # each component is an eigenvector: the projections of V agree with it
    load = centred.T @ white / n  # = V w / sqrt(e)
    for c in range(k):
        unit = load[:, c] / np.linalg.norm(load[:, c])
        assert np.abs(cov @ unit - lam[c] * unit).max() < 1e-8 * lam[0]


def test_query_against_a_dense_solver(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pylist()
    _check(queries.op13_embedding_whitening(spark, SF).collect(), [(r["vec_id"], r["embedding"]) for r in t])


def _table(spark, rows):
    return spark.createDataFrame([(i, v, "a", 3, [1]) for i, v in rows], "vec_id bigint, embedding array<float>, i string, n int, x array<int>")


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.standard_normal(6)]) for i in range(200)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(100)]  # copies count once
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("inf")] + [0.0] * 5)]
    _check(W.whiten(_table(spark, rows).repartition(7)).collect(), rows)
    more = rows[:5] + [(None, rows[0][1]), (None, rows[0][1]), (900, [1.0, 2.0])]
    got = W.whiten(_table(spark, more)).collect()
    assert len([r for r in got if r.vec_id is None]) == 2 * len({r.component for r in got}) and {r.n for r in got} == {6}


def test_few_dimensions_no_variance_and_empty(spark):
    assert {r.component for r in W.whiten(_table(spark, [(0, [0.25, 0.5]), (1, [0.75, -0.25]), (2, [1.0, 1.0])])).collect()} == {1, 2}
    for rows in ([], [(0, None)], [(0, [])], [(0, [1.0, 2.0]), (1, [1.0, 2.0])]):
        assert W.whiten(_table(spark, rows)).count() == 0


def test_large_entries(spark):
    rows = [(0, [1e12, 0.0]), (1, [-1e12, 1.0]), (2, [3.0, 2.0])]
    got = W.whiten(_table(spark, rows)).collect()
    assert got and {r.deviation for r in got if r.vec_id == 0} == {None}
