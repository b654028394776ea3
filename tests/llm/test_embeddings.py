"""Recall of the embedding hashes at the threshold, against brute force."""

import numpy as np
import pytest

from hourwise.llm import embeddings


def planted(dim: int, n: int, low: float = 0.9, high: float = 0.92) -> np.ndarray:
    """n pairs of cosine ``low`` to ``high``: row i and row n + i."""
    rng = np.random.default_rng(dim)
    a = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((n, dim))
    o -= (o * a).sum(axis=1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    c = rng.uniform(low + 1e-6, high, (n, 1))
    return np.concatenate([a, c * a + np.sqrt(1 - c * c) * o])


@pytest.mark.parametrize("dim", [3, 16, 64, 384, 768])
def test_tables_follow_the_dimension(dim):
    n = 300
    x = planted(dim, n)
    v = embeddings.vertices(x, embeddings.tables(dim, 0.9))
    first, at_i = embeddings._meeting(v, np.arange(n), np.arange(n) + n)
    assert (first >= 0).mean() >= 0.95
    # the table and side of the meeting are those of the bucket keys
    k = embeddings.buckets(v, dim)
    i_home, j_home = (k[:n, :, :1] == k[n:]).any(axis=2), (k[n:, :, :1] == k[:n]).any(axis=2)
    either = i_home | j_home
    assert (np.where(either.any(axis=1), either.argmax(axis=1), -1) == first).all()
    met = np.flatnonzero(first >= 0)
    assert (i_home[met, first[met]] == at_i[met]).all()


def test_hadamard_is_the_recursive_one():
    for d in (2, 8, 32, 64, 512):
        x = np.random.default_rng(d).standard_normal((5, d))
        h = np.ones((1, 1))
        while len(h) < d:
            h = np.kron([[1, 1], [1, -1]], h)
        assert np.allclose(embeddings._hadamard(x), x @ h)


def test_links_near_the_threshold(spark):
    """Whole operator on pairs of cosine 0.90 to 0.92 in 64 and 384 dimensions at once, repeats and a group cut into blocks
    among them: no link is below the threshold, few are missed, each is counted once."""
    rows, want, at = [], {}, 0
    for dim in (64, 384):
        x = planted(dim, 200)
        base = np.random.default_rng(9).standard_normal(dim)
        group = base + 0.02 * np.random.default_rng(10).standard_normal((600, dim))  # one bucket of several blocks
        x = np.concatenate([x, x[:1], group])
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
        for i, r in enumerate(x):
            rows.append((at + i, r.tolist()))
            want[at + i] = int(links[i])
        at += len(x)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.99 * sum(want.values())
    for start in (0, 1001):  # the planted pairs
        pairs = range(start, start + 400)
        assert sum(got[k] for k in pairs) >= 0.95 * sum(want[k] for k in pairs)
        assert all(got[k] == want[k] for k in range(start + 401, start + 1001))  # the group, whole
