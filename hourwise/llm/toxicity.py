"""Toxicity by a factorization machine over hashed terms.

Terms of a document are its distinct words ``[a-z0-9]`` (and everything beyond ASCII, lower-cased A-Z) and their first four
bytes, each a 64-bit hash.  The machine scores w0 + sum w_i + sum over pairs <v_i, v_j>, so an insult and a group mention
together can weigh more than their sum.

Fitting: the distinct texts of labelled documents whose crc32(doc_id) mod 4 is not 2; copies are one text, of the largest label
among them.  The cluster counts, over all of them, in how many texts of each label a term stands; the ``TERMS`` terms that tell
the labels apart best (in at least ``MIN_DOCS`` texts) are the model's inputs.  The weights are fitted in one task on at most
``SAMPLE`` of these texts of each label (the ones with the least hash of the text), which hold the selected terms only.  Both
labels weigh the same there, and a text without inputs, not toxic, weighs as much as a label does, which holds w0 down.  The
model has TERMS x (2 + RANK) numbers whatever the input, so it is broadcast.

Scoring is one pass over whole texts.  ``labels``, ``lang``, ``source`` and ``doc_id`` are no inputs of a score.

Edge cases: texts without any of the inputs (null, empty, no words, unknown words only) give no evidence and score 0, whatever
the bias; without labels of both kinds every score is 0; repeated labels of a document count once, the larger wins; repeated rows get the same score.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwise.llm.common import ALNUM, U, Words, longs, parts, staged

TERMS, MIN_DOCS, SAMPLE, RANK, PREFIX, THRESHOLD = 2048, 5, 4000, 4, 4, 0.3
EPOCHS, RATE, L2 = 30, 0.2, 1e-4


def held_out(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 2, F.lit(False))


def _doc_terms(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of the distinct terms of each row."""
    w = Words(col, ALNUM, prefixes=(PREFIX,))
    row = np.concatenate([w.row, w.row])
    term = np.concatenate([w.hash, w.prefix[PREFIX]])
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    return row[new], term[new]


def _count(batches):
    """Per slice: in how many documents of each label each term stands."""
    for b in parts(batches):
        row, term = _doc_terms(b.column("text"))
        y = b.column("toxic").to_numpy()[row]
        v, back = np.unique(term, return_inverse=True)
        pos = np.bincount(back, y, len(v)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([longs(v), longs(pos), longs(np.bincount(back, minlength=len(v)) - pos)], ["term", "pos", "neg"])


def _pick(terms: np.ndarray):
    """Documents as lists of model inputs."""

    def run(batches):
        for b in parts(batches):
            row, at = _inputs(b.column("text"), terms)
            n = np.bincount(row, minlength=len(b))
            off = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.ListArray.from_arrays(off, pa.array(at.astype(np.int32)))], ["toxic", "inputs"])

    return run


def _inputs(col: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, input) of the distinct model inputs of each row, by row."""
    w = Words(col, ALNUM, prefixes=(PREFIX,))
    if not len(terms) or not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marks = np.zeros(1 << 16, dtype=bool)
    marks[(terms >> U(48)).astype(np.int64)] = True
    row, found = [], []
    for h in (w.hash, w.prefix[PREFIX]):
        near = np.flatnonzero(marks[(h >> U(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(terms, h[near]), len(terms) - 1)
        ok = terms[at] == h[near]
        row.append(w.row[near[ok]])
        found.append(at[ok])
    pair = np.unique(np.concatenate(row) * len(terms) + np.concatenate(found))
    return pair // len(terms), pair % len(terms)


class Machine:
    """Factorization machine over binary inputs."""

    def __init__(self, n: int):
        rng = np.random.default_rng(7)
        self.w0, self.w, self.v = 0.0, np.zeros(n), rng.normal(0, 0.01, (n, RANK))

    def raw(self, row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = self.w0 + np.bincount(row, self.w[at], n)
        for f in range(RANK):
            x = self.v[at, f]
            out += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return out

    def fit(self, docs: list[np.ndarray], y: np.ndarray) -> Machine:
        """Adagrad over mini-batches of 64; both labels weigh the same, as does a text without inputs of label 0."""
        rng = np.random.default_rng(11)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        g0, gw, gv = 1e-8, np.full(len(self.w), 1e-8), np.full(self.v.shape, 1e-8)
        for _ in range(EPOCHS):
            order = rng.permutation(len(docs))
            for s in range(0, len(order), 64):
                ids = order[s : s + 64]
                row = np.repeat(np.arange(len(ids)), [len(docs[i]) for i in ids])
                at = np.concatenate([docs[i] for i in ids]).astype(np.int64) if len(row) else np.zeros(0, np.int64)
                p = 1 / (1 + np.exp(-np.clip(self.raw(row, at, len(ids)), -30, 30)))
                err = (p - y[ids]) * weight[ids] / len(ids)
                d = err.sum() + 0.5 / (1 + np.exp(-np.clip(self.w0, -30, 30)))  # the text without inputs
                g0 += d * d
                self.w0 -= RATE * d / np.sqrt(g0)
                used, back = np.unique(at, return_inverse=True)
                d = np.bincount(back, err[row], len(used)) + L2 * self.w[used]
                gw[used] += d * d
                self.w[used] -= RATE * d / np.sqrt(gw[used])
                for f in range(RANK):
                    x = self.v[at, f]
                    total = np.bincount(row, x, len(ids))
                    d = np.bincount(back, err[row] * (total[row] - x), len(used)) + L2 * self.v[used, f]
                    gv[used, f] += d * d
                    self.v[used, f] -= RATE * d / np.sqrt(gv[used, f])
        return self


def _fit(n: int):
    """The whole bounded sample, in one task; returns the machine's numbers."""

    def run(batches):
        y, docs = [], []
        for b in batches:
            y += b.column("toxic").to_pylist()
            docs += [np.array(x, dtype=np.int64) for x in b.column("inputs").to_pylist()]
        if len(set(y)) == 2:
            m = Machine(n).fit(docs, np.array(y))
            out = io.BytesIO()
            np.savez(out, w0=m.w0, w=m.w, v=m.v)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, bytes | None]:
    """(sorted term hashes, the machine) from the labelled documents outside the held-out fold."""
    y = labels.where("toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic"))
    text = F.coalesce("text", F.lit(""))
    digest = F.concat(F.hex(F.xxhash64(F.lit(1), text)), F.hex(F.xxhash64(text, F.lit(2))))
    all_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), digest.alias("digest"))
    # label and representative of each distinct text are settled on digests; then the texts move once, to their labels
    learnt = all_docs.where("doc_id is not null").where(~held_out(F.col("doc_id"), 4))
    narrow = learnt.select("doc_id", "digest")
    # sort-merge at every size: labels grow with the documents
    chosen = narrow.join(y.hint("merge"), "doc_id").groupBy("digest").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    # rows of one doc_id and digest lie together after the join: repeated rows go without another shuffle
    train = staged(
        learnt.join(chosen.hint("merge"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
        .select("toxic", F.xxhash64("text").alias("pick"), "text")
    )
    totals = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(totals) < 2:
        return np.zeros(0, np.uint64), None
    counts = train.select("toxic", "text").mapInArrow(_count, "term long, pos long, neg long").groupBy("term").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    p, q = (F.col("pos") + 0.5) / (totals[1] + 1.0), (F.col("neg") + 0.5) / (totals[0] + 1.0)
    gain = F.abs(F.log(p / q)) * F.sqrt(F.greatest(F.col("pos") / totals[1], F.col("neg") / totals[0]))
    best = counts.where(f"pos + neg >= {MIN_DOCS}").orderBy(gain.desc(), "term").limit(TERMS).select("term")
    terms = np.sort(np.array([r[0] for r in best.collect()], dtype=np.int64).view(np.uint64))  # TERMS numbers at most
    sample = None
    for label in (0, 1):
        of = train.where(F.col("toxic") == label)
        last = of.select("pick").orderBy("pick").limit(SAMPLE).agg(F.max("pick")).first()[0]  # one number
        part = of.where(F.col("pick") <= last)
        sample = part if sample is None else sample.unionByName(part)
    inputs = sample.select("toxic", "text").mapInArrow(_pick(terms), "toxic long, inputs array<int>")
    rows = staged(inputs).orderBy("toxic", "inputs").coalesce(1).mapInArrow(_fit(len(terms)), "model binary").collect()
    return terms, rows[0]["model"] if rows else None


def score(docs: DataFrame, terms: np.ndarray, model: bytes | None, name: str = "llm_score") -> DataFrame:
    """``docs`` (all columns) with the score as the last column, ``name``."""
    handle = docs.sparkSession.sparkContext.broadcast((terms.tobytes(), model))
    names = docs.columns

    def run(batches):
        raw, blob = handle.value
        t = np.frombuffer(raw, dtype=np.uint64)
        m = None
        if blob:
            z = np.load(io.BytesIO(blob))
            m = Machine(0)
            m.w0, m.w, m.v = float(z["w0"]), z["w"], z["v"]
        for b in parts(batches):
            n = len(b)
            p = np.zeros(n)
            if m:
                row, at = _inputs(b.column("text"), t)
                p = 1 / (1 + np.exp(-np.clip(m.raw(row, at, n), -30, 30)))
                p[np.bincount(row, minlength=n) == 0] = 0.0
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(p, pa.float64())], [*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{name}` double"
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    terms, model = fit(docs, labels)
    s = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), terms, model)
    return s.select(
        "doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), F.col("llm_score").alias("score"),
        (F.col("llm_score") >= threshold).cast("int").alias("predicted"),
    )
