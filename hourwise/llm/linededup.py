"""Line dedup with two Bloom filters.

A line's key is the line without the white space ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased.  Keys of at least
``min_chars`` code points that stand in at least ``min_docs`` documents lose all their lines except in the largest doc_id that
holds them; other lines stay, joined by line feeds.

1. Every task hashes the keys of its texts, each key once a text, cuts repeats inside the task to two, and sends the hashes to
   segments of the filters by their upper bits, so a key that holds a third of all lines is a few hashes a task.  A segment's
   task reads its hashes as a stream: a hash that the once-seen filter does not hold yet enters it, any other enters the
   twice-seen filter.  A repeat cannot be missed; about one single line in a hundred passes for one.
2. Only the twice-seen filter is broadcast.  Its size follows from the counted lines (4 to 8 bits a line) up to ``MAX_BITS``
   (128 MB); beyond about 250 million lines it fills up and passes more lines to the next step, which is exact at any size.
3. Lines that the filter holds, and only they, shuffle as (SHA-256 of the key, doc_id, row key).  Documents are counted and the
   largest doc_id chosen in two levels of aggregates, and the keys to drop are gathered by row key: one text's lines at most.
4. The texts meet their dropped keys in one join by row key, and lose these lines in SQL functions.

Edge cases: null and empty texts are one empty line; rows of one doc_id are one document, and lines go or stay alike in all of
them; rows of null doc_id are one document that is smaller than all others; repeats of a line inside the document that keeps
it all stay; columns beside doc_id and text are carried along, and helper columns take names that are not in use.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwise.llm.common import LOWER, U, free_names, lower_ascii, mix, parts, row_key, staged
from hourwise.llm.spans import Texts, span_hashes

MIN_CHARS, MIN_DOCS = 40, 5
#: Bits of one segment of a filter (a power of two), of the whole filter at most, and set by each hash.
SEGMENT, MAX_BITS, PROBES = 1 << 20, 1 << 30, 3
#: Hashes that a task gathers before it sends them.
FLUSH = 1 << 18
SPACE = " \t\n\x0b\x0c\r"


class Keys:
    """Keys of the long lines of a text column: row, span and hash, each key once a row."""

    def __init__(self, col: pa.Array, min_chars: int):
        t = Texts(col)
        self.low = LOWER[t.buf]
        row, start, end = t.lines()
        long = t.code_points(start, end) >= max(1, min_chars)
        self.row, self.start, self.end = row[long], start[long], end[long]
        self.hash = span_hashes(self.low, self.start, self.end)
        order = np.lexsort((self.hash, self.row))
        r, h = self.row[order], self.hash[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        self.first = np.sort(order[new])


def _places(h: np.ndarray) -> np.ndarray:
    """Bit numbers inside the segment, hashes x ``PROBES``."""
    m = mix(h ^ U(0x9B05688C2B3E6C1F))
    return np.stack([(m >> U(20 * i)) & U(SEGMENT - 1) for i in range(PROBES)], axis=1).astype(np.int64)


def _segment(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h >> U(32)) * U(segments) >> U(32)).astype(np.int64)


def _sightings(min_chars: int, segments: int):
    def send(held):
        h, n = np.unique(np.concatenate(held), return_counts=True)
        s = _segment(h, segments)
        cuts = [0, *(np.flatnonzero(np.diff(s)) + 1).tolist(), len(h)]
        spans = [(a, z) for a, z in zip(cuts, cuts[1:]) if z > a]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(s[a]) for a, _ in spans], pa.int32()),
                pa.array([h[a:z].tobytes() for a, z in spans], pa.binary()),
                pa.array([h[a:z][n[a:z] > 1].tobytes() for a, z in spans], pa.binary()),
            ],
            ["segment", "seen", "again"],
        )

    def run(batches):
        held, n = [], 0
        for b in parts(batches):
            k = Keys(b.column("text"), min_chars)
            held.append(k.hash[k.first])
            n += len(k.first)
            if n >= FLUSH:
                yield send(held)
                held, n = [], 0
        if n:
            yield send(held)

    return run


def _filters(batches):
    """The twice-seen filter of each segment; rows come sorted by segment and are read once."""
    now, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["segment", "bits"]
        )

    for b in batches:
        for s, seen, again in zip(*(b.column(i).to_pylist() for i in range(3))):
            if s != now:
                if now is not None:
                    yield done()
                now, once, twice = s, np.zeros(SEGMENT, dtype=bool), np.zeros(SEGMENT, dtype=bool)
            at = _places(np.frombuffer(seen, dtype=np.uint64))
            twice[at[once[at].all(axis=1)]] = True
            twice[_places(np.frombuffer(again, dtype=np.uint64))] = True
            once[at] = True
    if now is not None:
        yield done()


def twice_seen(texts: DataFrame, min_chars: int) -> tuple[int, np.ndarray]:
    """(segments, packed bits) of the twice-seen filter over all lines of ``texts``: ``MAX_BITS`` at most."""
    size, feeds = F.octet_length("text"), F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    # a line of the wanted length has min_chars bytes at least
    n = texts.agg(F.sum(F.least(size - feeds + 1, F.floor(size / max(1, min_chars))))).first()[0] or 0  # one number
    segments = 1
    while segments * SEGMENT < min(4 * n, MAX_BITS):
        segments *= 2
    sent = texts.mapInArrow(_sightings(min_chars, segments), "segment int, seen binary, again binary")
    rows = (
        sent.repartition("segment").sortWithinPartitions("segment").mapInArrow(_filters, "segment int, bits binary").collect()
    )  # MAX_BITS / 8 bytes at most
    bits = np.zeros((segments, SEGMENT // 8), dtype=np.uint8)
    for r in rows:
        bits[r["segment"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return segments, bits.reshape(-1)


def _suspects(min_chars: int, segments: int, handle):
    """Rows with lines that the twice-seen filter holds, and the digests of these lines' keys."""

    def run(batches):
        bits = handle.value
        for b in parts(batches):
            k = Keys(b.column("text"), min_chars)
            h = k.hash[k.first]
            at = _places(h) + (_segment(h, segments) * SEGMENT)[:, None]
            held = k.first[((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)]
            low = k.low.tobytes()
            found = [hashlib.sha256(low[s:e]).digest() for s, e in zip(k.start[held].tolist(), k.end[held].tolist())]
            row = k.row[held]
            n = np.bincount(row, minlength=len(b))
            some = np.flatnonzero(n)
            off = pa.array(np.concatenate([[0], np.cumsum(n[some])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("rk").take(pa.array(some)),
                    b.column("doc_id").take(pa.array(some)),
                    pa.ListArray.from_arrays(off, pa.array(found, pa.binary())),
                ],
                ["rk", "doc_id", "line_keys"],
            )

    return run


def _key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` (doc_id, text and any others) with the repeated lines out of ``text``, and the two counts as columns."""
    spark = docs.sparkSession
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    segments, bits = twice_seen(docs.select("text"), min_chars)
    handle = spark.sparkContext.broadcast(bits)  # MAX_BITS / 8 bytes at most
    held = staged(keyed.mapInArrow(_suspects(min_chars, segments, handle), "rk string, doc_id long, line_keys array<binary>"))
    lines = held.select("rk", "doc_id", F.explode("line_keys").alias("line_key"))
    repeated = (
        lines.groupBy("line_key", "doc_id").agg(F.lit(1).alias("one")).groupBy("line_key")
        .agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs)
    )
    gone = lines.join(repeated, "line_key").where("not (doc_id <=> keeper)")
    rk, drop, kept = free_names([*docs.columns, n_lines, n_dropped], "rk", "drop", "kept")
    drops = staged(gone.groupBy("rk").agg(F.collect_set("line_key").alias("gone"))).select(
        F.col("rk").alias(rk), F.col("gone").alias(drop)
    )
    text = F.coalesce("text", F.lit(""))
    all_lines = F.split(text, "\n", -1)
    stays = lambda line: ~F.array_contains(F.col(drop), F.unhex(F.sha2(_key(line), 256)))
    out = (
        docs.withColumn(rk, row_key(F.col("doc_id"), F.col("text"))).join(drops, rk, "left")
        .withColumn(kept, F.when(F.col(drop).isNotNull(), F.filter(all_lines, stays)))
    )
    n = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    same = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text", n_lines.lower(), n_dropped.lower())]
    return out.select(
        *same,
        F.when(F.col(kept).isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text"),
        n.alias(n_lines),
        F.when(F.col(kept).isNull(), F.lit(0).cast("long")).otherwise(n - F.size(kept)).alias(n_dropped),
    )
