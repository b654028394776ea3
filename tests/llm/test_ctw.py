"""Language-model scoring: the base score and counts against plain Python, and rows that are repeated often."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hourwise.llm import ctw

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FIELDS = "doc_id long, text string"


def brute_base(rows, folds=7):
    """(held_out, n_tokens, n_known, train_tokens, base_score) of each row."""
    end = object()
    said = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), end] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % folds == 2 for i, _ in rows]
    c = Counter(w for ws, h in zip(said, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [
        (h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        for ws, h in zip(said, held)
    ]


def rows_of(df):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in df.collect()), key=key)


TABLES = {
    "mixed": [(1, "One two TWO"), (2, None), (3, ""), (4, "two\tthree\x0bÄpfel"), (None, "one"), (9, "unheard words one"), (9, "unheard words one"), (9, "other")],
    "held out alone": [(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3],
    "empty": [],
}


@pytest.mark.parametrize("name", TABLES)
def test_base_score_and_counts(spark, name):
    rows = TABLES[name]
    got = rows_of(ctw.score_texts(spark.createDataFrame(rows, FIELDS)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    want = sorted(((i, *b) for (i, _), b in zip(rows, brute_base(rows))), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)


def test_rows_repeated_often(spark):
    """A row that stands 10,000 times counts 10,000 times, but only a few rows of it reach its block."""
    rows = [(i, f"word{i % 5} text{i} more") for i in range(30)]
    hot = [(1000, "hot row said again")] * 10_000
    df = spark.createDataFrame(rows + hot, FIELDS).repartition(4)
    got = rows_of(ctw.score_texts(df))
    assert len(got) == len(rows) + len(hot) and sum(g[0] == 1000 for g in got) == len(hot)
    base = dict(zip([i for i, _ in rows] + [1000], brute_base(rows + hot)))
    assert all(g[1:5] == base[g[0]][:4] and g[5] == pytest.approx(base[g[0]][4], rel=1e-9) for g in got)
    assert len({g[5] for g in got if g[0] == 1000}) == 1


def test_equal_rows_of_a_batch_are_merged():
    b = pa.RecordBatch.from_arrays(
        [pa.array([1, None, 1, None, 2], pa.int64()), pa.array(["x", "x", "x", "x", ""]), pa.array([False] * 5), pa.array([0, 1, 0, 1, 0], pa.int32())],
        ["doc_id", "text", "held_out", "block"],
    )
    (m,) = ctw._merged([b])
    assert sorted(map(str, m.to_pylist())) == sorted(
        str(dict(doc_id=i, text=t, held_out=False, block=k, times=n)) for i, t, k, n in [(1, "x", 0, 2), (None, "x", 1, 2), (2, "", 0, 1)]
    )


def test_scores_do_not_depend_on_how_rows_are_dealt(spark):
    rows = [(i, f"some text {i % 3}") for i in range(12)] * 3
    one = spark.createDataFrame(rows, FIELDS).coalesce(1)
    many = spark.createDataFrame(rows, FIELDS).repartition(9)
    a, b = (sorted((r.doc_id, r.score) for r in ctw.score_texts(d).collect()) for d in (one, many))
    assert [x[0] for x in a] == [x[0] for x in b] and [x[1] for x in a] == pytest.approx([x[1] for x in b], rel=1e-12)


def test_texts_are_scored_as_they_come():
    """A task holds its block's values, not its texts: each batch of texts is scored before the next one is read."""
    texts = ["a b", "b", None, ""]
    train = pa.RecordBatch.from_arrays(
        [pa.array([1, 2, 3, None], pa.int64()), pa.array(texts), pa.array([False] * 4), pa.array([5] * 4, pa.int32()), pa.array([1] * 4)],
        ["doc_id", "text", "held_out", "block", "times"],
    )
    names = ["block", "kind", "key", "value", "text"]
    seen = list(ctw._report([train]))
    values = [pa.RecordBatch.from_arrays([r.column("block"), r.column("kind"), r.column("key"), r.column("train").cast(pa.float64()), pa.nulls(len(r), pa.string())], names) for r in seen]
    docs = lambda kind: pa.RecordBatch.from_arrays(
        [pa.array([5] * 4, pa.int32()), pa.array([kind] * 4, pa.int32()), train.column("doc_id"), pa.array([1.0, 1, 1, 3]), train.column("text")], names
    )
    read = []

    def stream():
        for b in [*values, docs(ctw.TRAIN), docs(ctw.TRAIN), docs(ctw.HELD_OUT)]:
            read.append(len(b))
            yield b

    out = []
    for n, b in enumerate(ctw._score(7, 2)(stream())):
        assert len(read) == len(values) + n + 1
        out += b.to_pylist()
    assert [r["doc_id"] for r in out] == [1, 2, 3, None] * 3 and [r["held_out"] for r in out] == [False] * 8 + [True] * 4
    assert [(r["n_tokens"], r["n_known"], r["times"]) for r in out] == [(3, 3, 1), (2, 2, 1), (1, 1, 1), (1, 1, 3)] * 3


def numbered_texts(spark):
    return spark.createDataFrame([(i, f"Text {i} says word{i % 5} and\t{'more ' * (i % 4)}") for i in range(60)], FIELDS)


def test_a_task_has_one_block(spark, monkeypatch):
    """Two blocks in one task would be sorted together; the blocks here are more than the shuffle partitions."""

    def counted(total, kinds):
        def run(batches):
            n = len({x for b in batches for x in b.column("block").to_pylist()})
            if n:
                row = dict(doc_id=n, held_out=False, n_tokens=0, n_known=0, train_tokens=0, base_score=0.0, score=0.0, times=1)
                yield pa.RecordBatch.from_pylist([row])

        return run

    monkeypatch.setattr(ctw, "BLOCK", 300)
    monkeypatch.setattr(ctw, "_score", counted)
    blocks = [r.doc_id for r in ctw.score_texts(numbered_texts(spark)).collect()]
    assert len(blocks) > 12 and set(blocks) == {1}


def test_scores_do_not_depend_on_the_blocks(spark, monkeypatch):
    df = numbered_texts(spark)
    one = sorted(map(tuple, ctw.score_texts(df).collect()))
    monkeypatch.setattr(ctw, "BLOCK", 300)
    many = sorted(map(tuple, ctw.score_texts(df).collect()))
    assert [r[:5] for r in one] == [r[:5] for r in many]
    assert [r[5:] for r in many] == [pytest.approx(r[5:], rel=1e-12) for r in one]


def test_a_decision_at_a_time_covers_all_eight():
    """The decisions of one place in the byte share no node with the others: together they hold each key eight times."""
    key = ctw.grams(pa.array(["some text to be split", "Some other text"]))[1]
    key, count = ctw._sums([key], [np.ones(len(key), np.int64)])
    nodes = [ctw._leaves(key, count, j)[0] for j in range(8)]
    for level in range(ctw.DEPTH - ctw.ROOT + 1):
        all_nodes = np.concatenate([n[level].node for n in nodes])
        assert len(np.unique(all_nodes)) == len(all_nodes)
        assert [n[level].n.sum() for n in nodes] == [count.sum()] * 8
