"""Whitening against a plain eigensolver and whole-number sums."""

import math

import numpy as np

from bellwire.llm import whitening


def test_factor_and_eigenvalues():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((40, 9)) * 10.0 ** -np.arange(9)
    v = a.T @ a
    factor = whitening.pivoted_cholesky(v)
    assert np.allclose(factor @ factor.T, v)
    values, basis = whitening.one_sided_jacobi(factor)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    assert np.allclose(values[:6], want[:6], rtol=1e-9) and np.allclose(basis.T @ basis, np.eye(len(values)), atol=1e-12)
    # Two dimensions that repeat others are no rank, and one dimension needs no turning.
    b = np.hstack([a[:, :3], a[:, :2]])
    assert whitening.pivoted_cholesky(b.T @ b).shape[1] == 3
    assert whitening.one_sided_jacobi(np.array([[2.0]]))[0].tolist() == [4.0]
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape[1] == 0


def check(rows, vectors, top):
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in vectors])
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    assert len(rows) == n * top and {r.component for r in rows} == set(range(1, top + 1))
    away = sorted((i, int(((n * w - s) ** 2).sum())) for (i, _), w in zip(vectors, x))
    assert sorted({(r.vec_id, r.deviation) for r in rows}) == sorted(set(away))
    for c in range(1, top + 1):
        mine = sorted((r.vec_id, r.whitened) for r in rows if r.component == c)
        theirs = sorted((i, float(p)) for (i, _), p in zip(vectors, centred @ u[:, c - 1] / math.sqrt(e[c - 1])))
        one, two = np.array([w for _, w in mine]), np.array([w for _, w in theirs])
        assert min(np.abs(one - two).max(), np.abs(one + two).max()) < 1e-8
    first = rows[0]
    assert first.n == n and first.identity_error < 1e-8
    assert all(math.isclose(r.explained, e[r.component - 1] / e.sum(), rel_tol=1e-9) for r in rows)


def test_table(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check(whitening.whiten(vectors).collect(), [(r.vec_id, [float(c) for c in r.embedding]) for r in vectors.collect()], 8)


def test_odd_rows_and_low_rank(spark):
    rng = np.random.default_rng(1)
    good = [(i, (rng.integers(-3000, 3000, 3) @ np.array([[1, 0, 0, 1, 2], [0, 1, 0, -1, 0], [0, 0, 1, 0, 5]]) / 1024.0).tolist()) for i in range(60)]
    good += [(3, good[3][1])] * 5
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] * 5), (104, [float("-inf")] * 5), (105, [1.0])]
    schema = "vec_id long, embedding array<double>, component string, n int, whitened string"
    table = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in good + bad], schema).repartition(3)
    check(whitening.whiten(table).collect(), good, 3)
    assert whitening.whiten(table.where("vec_id = 3")).count() == 0 and whitening.whiten(table.where("false")).count() == 0
    alone = spark.createDataFrame([(None, [0.5, 1.0]), (2, [1.5, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(round(abs(r.whitened), 9) for r in whitening.whiten(alone).collect()) == [1.0, 1.0]


def test_deviations_beyond_64_bits():
    block = np.array([[1 << 50, 3]])
    d = whitening._deviations(block, 1 << 20, np.array([7, 1 << 70], object))
    assert d.tolist() == [[(1 << 70) - 7, 3 * (1 << 20) - (1 << 70)]]
