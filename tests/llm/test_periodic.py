"""Periodic runs against brute force over all periods."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hourwise.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """(start, length, period) of every run, by start and period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        s = 0
        for i in range(n - q + 1):
            if i == n - q or words[i] != words[i + q]:
                if i - s + q >= max(6, 4 * q):
                    found.setdefault((s, i + q), q)
                s = i + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def texts():
    rng = np.random.default_rng(4)
    pick = lambda k, n: [f"w{i}" for i in rng.integers(0, k, n)]
    out = [[], ["x"], ["x"] * 5, ["x"] * 6, ["a", "b"] * 3, ["a", "b"] * 4, fibonacci(300), [f"t{bin(i).count('1') & 1}" for i in range(300)]]
    for _ in range(60):
        out.append(pick(2, int(rng.integers(0, 150))))
        block = pick(3, int(rng.integers(1, 40)))
        out.append(pick(50, 10) + block * int(rng.integers(1, 9)) + block[:3] + pick(50, 10))
        out.append([w for _ in range(8) for w in pick(2, int(rng.integers(1, 9))) * int(rng.integers(1, 7))])
        out.append((["z"] * int(rng.integers(1, 15)) + ["y"]) * int(rng.integers(1, 12)))
    out.append([f"w{i % 977}" for i in range(20_000)])
    return out


def test_runs_and_collapsed_text_equal_brute_force(spark):
    cases = texts()
    rows = [(i, ("\t \n" if i % 2 else " ").join(w) + " " * (i % 3)) for i, w in enumerate(cases)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in periodic.periodic_runs(docs).collect():
        words = cases[r.doc_id]
        want = brute(words) if len(words) < 5000 else [(0, 20_000, 977)]
        assert [tuple(x) for x in r.runs] == want, words[:50]
        assert (r.words, r.collapsed) == (len(words), collapsed(words, want))


def test_slices_of_texts_do_not_touch(monkeypatch):
    monkeypatch.setattr(periodic, "SLICE", 100)  # two or three texts a slice
    batch = pa.RecordBatch.from_arrays([pa.array(["a b " * i for i in range(12)])], ["text"])
    slices = list(periodic._scan("text", [], ("words", "runs", "collapsed"))([batch]))
    assert len(slices) > 3
    got = [[tuple(r.values()) for r in runs] for s in slices for runs in s.column("runs").to_pylist()]
    assert got == [brute(["a", "b"] * i) for i in range(12)]


@pytest.mark.parametrize("empty", [False, True])
def test_edges(spark, empty):
    rows = [(1, "a a a a a a"), (1, "a a a a a a"), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r"), (None, "B b B b B b B b é"), (5, "x x x x x x"), (6, "A a A a A a")]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string")
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["RUNS", "collapsed", "words", "words_", "n"])])
    out = periodic.periodic_runs(docs)
    assert out.columns == [*docs.columns, "words__", "runs_", "collapsed_"]
    got = sorted((r.doc_id or 0, r.words, r.RUNS, len(r.runs_), r.collapsed_) for r in out.collect())
    want = [(0, 9, 0, 1, "B b é"), (1, 0, 0, 1, "a"), (1, 0, 0, 1, "a"), (2, 2, 0, 0, ""), (3, 2, 0, 0, ""), (4, 2, 0, 0, ""), (5, 2, 0, 0, rows[6][1]), (6, 2, 0, 0, "A a A a A a")]
    assert got == ([] if empty else sorted((i, 2, r, n, c) for i, _, r, n, c in want))


def expected_row(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs)),
    )


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{j}" for j in rng.integers(0, 9, int(rng.integers(0, 90))))) for i in range(400)]
    rows += [(None, None), (None, "a a a a a a a"), (3, None), (3, ""), (11, "x " * 30), (11, "x " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_periodic_runs(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in out.schema][1:6] == ["bigint"] * 5
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted((expected_row(*r) for r in rows), key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(400)) > 20
