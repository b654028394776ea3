"""Benchmark decontamination as a prefix-filtered set join.

Words are ``[a-z0-9]`` and all characters beyond ASCII of the lower-cased text.  A benchmark item's windows are its
runs of ``window`` words (an item of fewer words is one window).  A window is the set of its shingles of ``k`` words
(or of all its words, if fewer); an occurrence contains all of them, so with shingles ordered by rarity in the
corpus the necessary prefix is the rarest one.  Steps:

1. count, over all documents, the item shingles (map side, behind a Bloom filter of fixed size);
2. per distinct window, its rarest shingle is its prefix token;
3. documents emit only their prefix tokens, with the words around them, and join the windows on the token;
4. positional bound (the window has to start at or after the first word), length bound (and to end before the last),
   then the words of the whole window are compared.

The Bloom filter has ``BLOOM_BITS`` bits whatever the input; a fuller one lets more rows through, and loses none.

Edge cases: null texts have no words; repeated rows get the same result each; an empty benchmark hits nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourwise.llm.common import ALNUM, U, Words, longs, mix, parts, row_key, staged

BLOOM_BITS = 1 << 23
_SEEDS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))


def _bits(h: np.ndarray) -> np.ndarray:
    return np.stack([mix(h ^ s) % U(BLOOM_BITS) for s in _SEEDS])


def _tokens(w: Words, sizes: list[int]):
    """(position, hash, size) of all shingles of the sizes; the size is mixed into the hash."""
    for k in sizes:
        h, whole = w.shingles(k)
        yield np.flatnonzero(whole), mix(h[whole] + U(k)), k


def _strings(w: Words) -> np.ndarray:
    data = w.low.tobytes()
    return [data[a:b].decode("utf-8") for a, b in zip(w.start, w.end)]


def item_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """(item_id, words, size, offset, token): every shingle of every window of the items."""

    def run(batches):
        for b in parts(batches):
            ids = b.column("item_id").to_pylist()
            w = Words(b.column("text"), ALNUM)
            words = _strings(w)
            h = {}
            out = {"item_id": [], "words": [], "size": [], "offset": [], "token": []}
            for i, item in enumerate(ids):
                a, n = w.first[i], w.count[i]
                for start in range(a, a + max(1, n - window + 1) if n else a):
                    size = min(window, n)
                    kk = min(k, size)
                    if kk not in h:
                        hh, _ = w.shingles(kk)
                        h[kk] = mix(hh + U(kk)).view(np.int64)
                    for o in range(size - kk + 1):
                        out["item_id"].append(item)
                        out["words"].append(" ".join(words[start : start + size]))
                        out["size"].append(size)
                        out["offset"].append(o)
                        out["token"].append(int(h[kk][start + o]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["item_id"], pa.int64()), pa.array(out["words"], pa.string()), pa.array(out["size"], pa.int32()),
                 pa.array(out["offset"], pa.int32()), pa.array(out["token"], pa.int64())], list(out))

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        run, "item_id long, words string, size int, offset int, token long"
    )


def bloom(tokens: DataFrame) -> np.ndarray:
    """Bloom filter of a ``token`` column: at most ``BLOOM_BITS / 64`` words reach the driver."""

    def run(batches):
        for b in batches:
            at = np.unique(_bits(b.column("token").to_numpy(zero_copy_only=False).view(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [longs(at >> U(6)), longs(np.left_shift(U(1), at & U(63)))], ["word", "bits"]
            )

    rows = tokens.select("token").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    t = rows.toArrow()
    out = np.zeros(BLOOM_BITS // 64, dtype=np.uint64)
    out[t.column("word").to_numpy()] = t.column("bits").to_numpy().view(np.uint64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _seen(filter_bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(filter_bits[(mix(h ^ _SEEDS[0]) % U(BLOOM_BITS)).astype(np.int64)])
    ok = np.zeros(len(h), dtype=bool)
    ok[at] = filter_bits[_bits(h[at]).astype(np.int64)].all(axis=0)
    return ok


def _count(handle, sizes):
    def run(batches):
        bits = np.unpackbits(np.frombuffer(handle.value, np.uint8), bitorder="little").astype(bool)
        for b in parts(batches):
            w = Words(b.column("text"), ALNUM)
            for _, h, _k in _tokens(w, sizes):
                v, c = np.unique(h[_seen(bits, h)], return_counts=True)
                yield pa.RecordBatch.from_arrays([longs(v), longs(c)], ["token", "n"])

    return run


_CAND = "array<struct<token:long,pos:int,first:int,ctx:string>>"


def _emit(handle, sizes, window):
    def run(batches):
        bits = np.unpackbits(np.frombuffer(handle.value, np.uint8), bitorder="little").astype(bool)
        kind = pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32()), ("first", pa.int32()), ("ctx", pa.string())]))
        for b in parts(batches):
            w = Words(b.column("text"), ALNUM)
            row = w.row
            found: list[list] = [[] for _ in w.count]
            data = w.low.tobytes()
            for at, h, _k in _tokens(w, sizes):
                for p, t in zip(at[ok := _seen(bits, h)], h[ok].view(np.int64)):
                    i = row[p]
                    lo, hi = max(w.first[i], p - window + 1), min(w.first[i + 1], p + window)
                    ctx = " ".join(data[x:y].decode("utf-8") for x, y in zip(w.start[lo:hi], w.end[lo:hi]))
                    found[i].append({"token": int(t), "pos": int(p - w.first[i]), "first": int(lo - w.first[i]), "ctx": ctx})
            yield pa.RecordBatch.from_arrays(
                [b.column("rk"), b.column("doc_id"), longs(w.count), pa.array(found, kind)], ["rk", "doc_id", "n_words", "found"]
            )

    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): rk (key of the row), doc_id, n_words, n_hit, n_items, item_ids (array of
    strings, sorted)."""
    spark = docs.sparkSession
    text = docs.select(
        row_key(F.col("doc_id"), F.col("text")).alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    win = staged(item_windows(items, window, k))
    sizes = sorted(r[0] for r in win.select(F.least("size", F.lit(k))).distinct().collect())  # k numbers at most
    pack = lambda b: spark.sparkContext.broadcast(np.packbits(b, bitorder="little").tobytes())
    counts = (
        text.select("text").mapInArrow(_count(pack(bloom(win)), sizes), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    )
    rare = Window.partitionBy("words").orderBy(F.coalesce("n", F.lit(0)), "offset")
    prefix = staged(
        win.select("words", "size", "offset", "token").distinct().join(counts, "token", "left")
        .withColumn("rank", F.row_number().over(rare)).where("rank = 1").drop("rank", "n")
    )
    doc_rows = staged(
        text.mapInArrow(_emit(pack(bloom(prefix)), sizes, window), f"rk string, doc_id long, n_words long, found {_CAND}")
    )
    cand = doc_rows.where("size(found) > 0").select("rk", "n_words", F.explode("found").alias("f")).select("rk", "n_words", "f.*").distinct()
    start = F.col("pos") - F.col("offset")
    inside = F.concat_ws(" ", F.slice(F.split("ctx", " "), start - F.col("first") + 1, F.col("size")))
    hits = staged(
        cand.join(prefix, "token")
        .where((start >= 0) & (start + F.col("size") <= F.col("n_words")))  # positional and length bounds
        .where(inside == F.col("words"))
        .select("rk", start.alias("at"), "size", "words")
    )
    so_far = F.max(F.col("at") + F.col("size")).over(
        Window.partitionBy("rk").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    covered = (
        hits.select("rk", "at", "size").distinct()
        .withColumn("new", F.greatest(F.lit(0), F.col("at") + F.col("size") - F.greatest("at", F.coalesce(so_far, F.lit(0)))))
        .groupBy("rk").agg(F.sum("new").cast("long").alias("n_hit"))
    )
    named = (
        hits.select("rk", "words").distinct()
        .join(win.select("words", "item_id").distinct(), "words")
        .groupBy("rk").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    per_doc = covered.join(named, "rk")
    return (
        doc_rows.drop("found").join(per_doc, "rk", "left")
        .select(
            "rk", "doc_id", "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        )
    )
