"""Line dedup against brute force, and the two filters."""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hourwise.llm import linededup, queries
from hourwise.llm.common import mix

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def brute(rows, min_chars=40, min_docs=5):
    """Per row: kept text, lines, dropped lines."""
    where = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            where[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stays = []
        for x in lines:
            w = where[key(x)]
            if len(key(x)) < min_chars or len(w) < min_docs or i == max(j for j in w if j is not None):
                stays.append(x)
        out.append((i, "\n".join(stays), len(lines), len(lines) - len(stays)))
    return out


def same(got, want):
    s = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert s(got) == s(want)


def corpus():
    rng = np.random.default_rng(6)
    pool = [f"Line {i} " + "shared words that many documents repeat " * (1 + i % 3) for i in range(40)]
    pool += ["é" * 39, "é" * 40, "x" * 39, "x" * 40, "y" * 41, "short", "", " " * 50, " " * 45]
    rows = []
    for i in range(160):
        lines = [pool[j] for j in rng.integers(0, len(pool), int(rng.integers(0, 9)))] + [f"own line of document {i}, seen nowhere else, ever"]
        if i % 3 == 0:
            lines.insert(0, " \t" + "One very hot line that a third of all documents hold\r")
        if i % 5 == 0:
            lines = [x.upper() for x in lines] + lines[:1]
        rows.append((i, "\n".join(lines)))
    return rows


def test_query_equals_brute_force(spark, tmp_path):
    rows = corpus() + [(500, "\n".join(["z" * 60] * 9)), (501, "z" * 60 + "\n"), (502, " " + "Z" * 60), (503, "z" * 60), (504, "\n" + "z" * 60), (505, "\n\n")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_line_dedup(spark, str(tmp_path))
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute(rows)]
    same(out.collect(), want)
    assert sum(d for _, _, d, _ in want) > 100


@pytest.mark.parametrize("empty", [False, True])
def test_edges(spark, empty):
    hot = "a line of forty characters or more, in many documents"
    rows = [(1, hot), (1, hot), (1, hot + "\nother"), (2, hot), (3, None), (4, ""), (5, hot), (None, hot), (None, hot), (6, hot + "\n" + hot), (7, None), (None, None)]
    rows = [] if empty else rows
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ["rk", "Drop", "kept", "line_key", "segment", "gone", "docs", "keeper", "line_keys", "bits"]
    docs = docs.select("*", *[F.lit(7).alias(c) for c in clash])
    out = linededup.dedup_lines(docs)
    assert set(out.columns) == {*docs.columns, "n_lines", "n_dropped"}
    same([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()], brute(rows))
    assert not empty and out.where("rk = 7 and Drop = 7 and kept = 7").count() == len(rows) or empty


def test_other_limits(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chars, n in ((1, 2), (60, 9), (0, 3)):
        got = linededup.dedup_lines(docs, chars, n)
        # without a least length the empty line counts as a key; the filters take keys of one code point at least
        same([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()], brute(rows, max(1, chars), n))


def test_saturated_filter_loses_nothing(spark, monkeypatch):
    """A filter far too small for the lines passes more of them, with the same result."""
    monkeypatch.setattr(linededup, "SEGMENT", 8)
    monkeypatch.setattr(linededup, "MAX_BITS", 8)
    rows = corpus()
    assert linededup._places(np.arange(9, dtype=np.uint64)).max() < 8
    from hourwise.llm.linededup import _filters, _sightings  # the same functions, run here with the small filter

    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], ["text"])
    sent = list(_sightings(40, 1)([batch]))
    bits = [b.column("bits")[0].as_py() for b in _filters(iter(sent))]
    assert bits == [b"\xff"]


def test_filters_hold_every_repeat_and_few_others():
    rng = np.random.default_rng(7)
    single = mix(np.arange(100_000, dtype=np.uint64))
    twice = mix(np.arange(10**6, 10**6 + 5000, dtype=np.uint64))

    def sent(h, again=b""):
        return pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int32()), pa.array([rng.permutation(h).tobytes()], pa.binary()), pa.array([again], pa.binary())], ["segment", "seen", "again"]
        )

    inside = mix(np.arange(2 * 10**6, 2 * 10**6 + 100, dtype=np.uint64))
    batches = [sent(np.concatenate([single[:50_000], twice])), sent(np.concatenate([single[50_000:], twice])), sent(inside, inside.tobytes())]
    (out,) = linededup._filters(iter(batches))
    bits = np.unpackbits(np.frombuffer(out.column("bits")[0].as_py(), dtype=np.uint8)).astype(bool)
    held = lambda h: bits[linededup._places(h)].all(axis=1)
    assert held(twice).all() and held(inside).all()
    assert held(single).mean() < 0.02
