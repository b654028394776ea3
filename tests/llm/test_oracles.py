"""The SQL of the training-data queries at sf0.001, and candidates of growing groups of near copies."""

import os

import duckdb
import numpy as np
import pytest

from hourwise.llm import minhash, queries, toxicity
from hourwise.llm.queries import table


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_matches_sql(spark, sf0001, key):
    con = duckdb.connect()
    for f in os.listdir(sf0001):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf0001}/{f}')")
    df = queries.QUERIES[key](spark, sf0001)
    want = con.execute(queries.ORACLES[key])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def near_copies(n, seed):
    """One text of 150 words and n copies, each with a few words of its own: most are linked to the text, not to each other."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(150)]
    out = [" ".join(base)]
    for i in range(n):
        t = list(base)
        for j in rng.choice(150, int(rng.integers(1, 5)), replace=False):
            t[j] = f"own{i}x{j}"
        out.append(" ".join(t))
    return out


def test_candidates_grow_with_the_group(spark, monkeypatch):
    seen = []
    whole = minhash._verified

    def counted(cand, sets, percent):
        seen[-1] += cand.count()
        return whole(cand, sets, percent)

    monkeypatch.setattr(minhash, "_verified", counted)
    for n in (300, 1200):
        seen.append(0)
        texts = near_copies(n, 1)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
        s = [set(t.split()[i : i + 5].__str__() for i in range(146)) for t in texts]
        near = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
        linked = [i for i in range(n + 1) if near(s[0], s[i])]
        assert 0.4 * n < len(linked) < n + 1 and all(got[i] == 0 for i in linked)
        if n == 300:  # all links of the smaller group, by plain comparison
            comp = list(range(n + 1))
            for i in range(n + 1):
                for j in range(i):
                    if comp[i] != comp[j] and near(s[i], s[j]):
                        a, b = sorted((comp[i], comp[j]))
                        comp = [a if c == b else c for c in comp]
            assert [got[i] for i in range(n + 1)] == comp
    assert seen[1] <= 6 * seen[0] and seen[1] < 20 * 1200, seen


def test_toxicity_forward_pass(spark, sf0001):
    """The scores are those of the machine's formula, term by term."""
    import io

    import pyarrow as pa

    docs = table(spark, sf0001, "documents")
    terms, model = toxicity.fit(docs, table(spark, sf0001, "labels"))
    z = np.load(io.BytesIO(model))
    got = toxicity.score(docs.select("doc_id", "text"), terms, model).toPandas()
    for _, r in got.head(60).iterrows():
        _, at = toxicity._inputs(pa.array([r.text]), terms)
        pairs = z["v"][at] @ z["v"][at].T  # every pair of terms, each once
        raw = float(z["w0"]) + z["w"][at].sum() + np.triu(pairs, 1).sum()
        want = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) if len(at) else 0.0
        assert abs(want - r.llm_score) < 1e-9
    assert docs.count() == len(got)
