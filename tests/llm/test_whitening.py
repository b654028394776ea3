"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourwise.llm import queries, whitening

FIELDS = "vec_id long, embedding array<float>"


def dense(vectors):
    """n, deviation, whitened (4 components at most) and explained of ``vectors`` in plain numpy."""
    x = np.floor(256 * np.asarray(vectors, dtype=np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    z = fit - total / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(4, int((e > 1e-13 * e.sum()).sum()))
    return n, ((n * x - total) ** 2).sum(axis=1), (x - total / n) @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_eigenpairs_of_several_spectra():
    rng = np.random.default_rng(1)
    for d, scale in ((1, [1]), (2, [1, 1]), (5, [3, 3, 3, 1, 1]), (40, np.geomspace(1, 1e-6, 40)), (64, np.ones(64)), (90, np.r_[np.ones(6) * 10, np.ones(84)])):
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        a = (q * np.asarray(scale, dtype=float)) @ q.T
        e, u = whitening.jacobi_davidson(lambda p, a=a: a @ p, d, 4)
        k = min(4, d)
        assert u.shape == (d, k)
        np.testing.assert_allclose(e, np.linalg.eigvalsh(a)[::-1][:k], rtol=1e-12)
        np.testing.assert_allclose(u.T @ u, np.eye(k), atol=1e-13)
        assert np.linalg.norm(a @ u - u * e, axis=0).max() < 1e-13 * e[0]


def test_products_are_few_and_never_whole():
    """The eigenvectors come from products with a few vectors, far fewer than the dimensions."""
    seen = []
    rng = np.random.default_rng(2)
    d = 300
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    a = (q * (1 / np.arange(1, d + 1))) @ q.T

    def times(p):
        seen.append(p.shape[1])
        return a @ p

    whitening.jacobi_davidson(times, d, 4)
    assert max(seen) <= 8 and len(seen) < 120


def test_query_equals_dense(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) * np.linspace(2, 0.5, 12)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a third of all rows is one vector
    bad = [(-1, None), (-2, [None] + [0.0] * 11), (-3, [float("nan")] * 12), (-4, [float("inf")] + [1.0] * 11), (-5, []), (-6, [1.0, 2.0])]
    spark.createDataFrame(rows + bad, FIELDS).withColumn("label", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_whitening(spark, str(tmp_path)).toPandas()
    n, deviation, whitened, explained = dense([v for _, v in rows])
    assert sorted(got.vec_id.unique()) == sorted(i for i, _ in rows) and len(got) == 4 * len(rows)
    assert (got.n == n).all() and n == 300 and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    for c in range(4):
        g = got[got.component == c + 1].set_index("vec_id").loc[[i for i, _ in rows]]
        assert (g.deviation.to_numpy() == deviation).all()
        sign = np.sign((g.whitened.to_numpy() * whitened[:, c]).sum())
        np.testing.assert_allclose(sign * g.whitened, whitened[:, c], atol=1e-10)
        np.testing.assert_allclose(g.explained, explained[c], rtol=1e-12)


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], [(1, []), (2, [])],
])
def test_no_variance_gives_no_rows(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, FIELDS)).collect() == []


def test_edges(spark):
    v = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (None, [1.0]), (3, [-0.0]), (4, [1.0, 2.0])], FIELDS)
    v = v.select("*", *[F.lit("?").alias(c) for c in ("x", "n", "dim", "whitened", "pos")])
    got = sorted((r.vec_id or 0, r.n, r.deviation, [round(w, 9) for w in r.whitened], r.explained) for r in whitening.whiten(v).collect())
    # x is 0 or 256: fit list of two
    assert got == [(0, 2, 256**2, [1.0], [1.0]), (1, 2, 256**2, [-1.0], [1.0]), (2, 2, 256**2, [1.0], [1.0]), (3, 2, 256**2, [-1.0], [1.0])]


def test_numbers_beyond_a_long(spark):
    big = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 3.0])]
    got = {r.vec_id: (r.deviation, len(r.whitened)) for r in whitening.whiten(spark.createDataFrame(big, FIELDS)).collect()}
    assert got[1][0] is None and got[2][0] is None and got[1][1] >= 1
    x = np.array([[2**40, 5], [1, 7]])
    assert whitening._deviations(x, 4, [9, 4]) == [None, (4 - 9) ** 2 + (28 - 4) ** 2]
    assert whitening._deviations(np.array([[2**30, 5]]), 2, [1, 4]) == [(2**31 - 1) ** 2 + 36]


def test_partial_sums_merge(spark, monkeypatch):
    """Many tasks add up in two levels."""
    monkeypatch.setattr(whitening, "TASK", 8)
    monkeypatch.setattr(whitening, "PARTS", 4)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3))
    fit = whitening.FitList(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], FIELDS), 3)
    f = np.floor(256 * x.astype(np.float32).astype(np.float64))
    z = f - f.mean(axis=0)
    np.testing.assert_allclose(fit.times(np.eye(3)), z.T @ z / 90, rtol=1e-12)
