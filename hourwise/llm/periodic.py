"""Periodic runs of words, found with string synchronising sets.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word extends
keeping q; those of at least max(``MIN_WORDS``, ``MIN_POWER`` * q) words are reported.  A word is dropped from the collapsed
text if any run contains it after that run's first q words.

All texts of a slice are one string of word hashes with a unique number behind each text.  At scale t = 1, 2, 4, ... over
the texts long enough for the scale:

* the synchronising set holds the positions i where the least hash of a t-word window among starts i..i+t is that at i or at
  i + t; whether i belongs follows from its context, the 2t words from i, alone, so equal contexts agree;
* windows inside a highly periodic region (period of t/3 words at most) do not count, or periodic stretches would fill the
  set.  These regions are the repetitions already found at smaller scales, which supply the small periods;
* a stretch of three periods q, 3t - 2 <= q <= 6t - 3, without a smaller period holds a position of the set whose context
  comes again q words later.  So positions are sorted by context, and neighbours in that order within 6t - 3 words of each
  other propose their distance as a period.  Equal contexts in the set are more than t/3 apart: at most 18 neighbours count;
* a proposed period is taken as far as words q apart are equal, compared word by word in growing chunks; positions inside a
  stretch found for the same q are passed over.

The ranges of q of the scales cover all periods.  Repetitions of three periods and more are kept for the regions of the larger
scales, runs are reported from four on.  Texts never leave their task: there is no shuffle.

Words are told apart by 64-bit hashes of their bytes.  Edge cases: null and empty texts and texts of white space have no words,
no runs and an empty collapsed text; repeated rows give equal results; columns beside the text are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hourwise.llm.common import NOT_SPACE, U, free_names, mix, parts
from hourwise.llm.spans import Texts, span_hashes

MIN_WORDS, MIN_POWER = 6, 4
#: Text bytes of one slice.
SLICE = 2 << 20
_TOP = U(2**64 - 1)


def _stretch(w: np.ndarray, j: int, q: int) -> tuple[int, int]:
    """The largest [s, e) around ``j`` in which w[i] == w[i + q]."""
    e, chunk = j, 4 * q + 16
    last = len(w) - q
    while e < last:
        z = min(e + chunk, last)
        bad = np.flatnonzero(w[e:z] != w[e + q : z + q])
        if len(bad):
            e += int(bad[0])
            break
        e, chunk = z, 2 * chunk
    s, chunk = j, 4 * q + 16
    while s > 0:
        a = max(0, s - chunk)
        bad = np.flatnonzero(w[a:s] != w[a + q : s + q])
        if len(bad):
            s = a + int(bad[-1]) + 1
            break
        s, chunk = a, 2 * chunk
    return s, e


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for every i, cut off at the end."""
    out, done = x.copy(), 1
    while done < width:
        step = min(done, width - done)
        out[:-step] = np.minimum(out[:-step], out[step:].copy())
        done += step
    return out


def _shifted(x: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(x), _TOP)
    out[: max(0, len(x) - k)] = x[k:]
    return out


def repetitions(w: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], int]:
    """(start, end) -> smallest period of all maximal repetitions of three periods and more.  ``w`` holds the words of all
    texts, a unique number behind each; text i is w[first[i] : first[i + 1] - 1]."""
    found: dict[tuple[int, int], int] = {}
    words = np.diff(first) - 1
    ids, at, t = w, None, 1
    text = np.repeat(np.arange(len(words)), words + 1)
    while True:
        # texts too short for three of this scale's least periods leave the string
        enough = words >= 3 * (3 * t - 2)
        if not enough.any():
            return found
        keep = enough[text]
        if at is None:
            at = np.arange(len(w))
        if not keep.all():
            ids, at, text = ids[keep], at[keep], text[keep]
        double = mix(ids * U(0x9E3779B97F4A7C15) + _shifted(ids, t) + U(t))  # hashes of 2t words: the contexts
        count = np.where(ids == _TOP, _TOP - U(1), ids)
        if t >= 4:
            flat = np.zeros(len(at) + 1, dtype=np.int64)
            for (s, e), q in found.items():
                if 3 * q <= t <= e - s:
                    a, z = np.searchsorted(at, [s, e - t + 1])
                    flat[a] += 1
                    flat[z] -= 1
            count[np.cumsum(flat[:-1]) > 0] = _TOP
        low = _window_min(count, t + 1)
        chosen = np.flatnonzero((low != _TOP) & ((low == count) | (low == _shifted(count, t))))
        order = chosen[np.argsort(double[chosen], kind="stable")]
        context, place = double[order], at[order]
        jobs = []
        for g in range(1, 6 * t):
            if g >= len(order):
                break
            far = place[g:] - place[:-g]
            near = (context[g:] == context[:-g]) & (far <= 6 * t - 3)
            if not near.any():
                break
            hit = np.flatnonzero(near & (far >= 3 * t - 2))
            jobs.append(np.stack([far[hit], place[hit]], axis=1))
        if jobs:
            jobs = np.concatenate(jobs)
            jobs = jobs[np.lexsort((jobs[:, 1], jobs[:, 0]))]
            q_now, past = 0, 0
            for q, j in jobs.tolist():
                if q != q_now:
                    q_now, past = q, 0
                if j < past:
                    continue
                s, e = _stretch(w, j, q)
                past = e
                if e + q - s >= 3 * q:
                    found.setdefault((s, e + q), q)  # ascending q: the smallest stays
        ids, t = double, 2 * t


def runs_of(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Reported runs by start and period: text, start (word of the text), length, period."""
    rows = [(s, e - s, q) for (s, e), q in repetitions(w, first).items() if e - s >= max(MIN_WORDS, MIN_POWER * q)]
    r = np.array(sorted(rows, key=lambda x: (x[0], x[2])), dtype=np.int64).reshape(-1, 3)
    text = np.searchsorted(first, r[:, 0], "right") - 1
    return np.column_stack([text, r[:, 0] - first[text], r[:, 1], r[:, 2]])


def _scan(column: str, names: list[str], extra: tuple[str, str, str]):
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in parts(batches, column, SLICE):
            t = Texts(b.column(column))
            start, end, first = t.words()
            n = np.diff(first)
            # words of text i stand from first[i] + i on, its unique number behind them
            w = np.empty(len(start) + t.rows, dtype=np.uint64)
            row = np.repeat(np.arange(t.rows), n)
            w[np.arange(len(start)) + row] = span_hashes(t.buf, start, end)
            marked = first + np.arange(t.rows + 1)
            w[marked[1:] - 1] = mix(np.arange(t.rows, dtype=np.uint64) + U(0xBB67AE8584CAA73B))
            r = runs_of(w, marked)
            # dropped words: those of a run behind its first period
            edge = np.zeros(len(start) + 1, dtype=np.int64)
            base = first[r[:, 0]] + r[:, 1]
            np.add.at(edge, base + r[:, 3], 1)
            np.add.at(edge, base + r[:, 2], -1)
            stays = np.cumsum(edge[:-1]) == 0
            # bytes of the words that stay, and one space behind each but the last of its text
            inside = NOT_SPACE[t.buf]
            step = np.zeros(len(t.buf) + 1, dtype=np.int8)
            step[start[~stays]] += 1
            step[end[~stays]] -= 1
            take = inside & (np.cumsum(step[:-1], dtype=np.int8) == 0)
            last = np.ones(len(start), dtype=bool)
            kept = np.flatnonzero(stays)
            last[kept[:-1]] = row[kept[1:]] != row[kept[:-1]]
            take[end[stays & ~last]] = True
            out = np.where(inside, t.buf, np.uint8(0x20))[take]
            size = np.concatenate([[0], np.cumsum(take)])[t.off]
            text = pa.LargeStringArray.from_buffers(t.rows, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
            off = np.concatenate([[0], np.cumsum(np.bincount(r[:, 0], minlength=t.rows))]).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(r[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(off), structs).cast(run_type)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(n, pa.int64()), lists, text], [*names, *extra])

    return run


def periodic_runs(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with three more columns: words (long), runs (array of start, length, period by start and period) and collapsed
    (the words that stay, joined by one space); their names get underscores where ``docs`` has them already."""
    names = docs.columns
    extra = tuple(free_names(names, "words", "runs", "collapsed"))
    types = ("bigint", "array<struct<start:bigint,length:bigint,period:bigint>>", "string")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{c}` {t}" for c, t in zip(extra, types)]
    return docs.mapInArrow(_scan(column, names, extra), ", ".join(fields))
