"""Shared helpers: staged tables, vectorised word hashing over Arrow text columns, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
_P, _PI = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Setting by which Spark deletes an execution's shuffle files when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Text bytes that one vectorised step handles; larger batches are cut at word ends.
STEP = 1 << 20


def stage_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # the executors of local-cluster[...] are processes
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="hourwise-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back: lineage ends there, and the shuffle files of
    the write are released with it."""
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(doc_id: Column, text: Column) -> Column:
    """128-bit key of (doc_id, text): rows that share it give the same result."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(
        F.hex(F.xxhash64(F.lit(1), doc_id, doc_id.isNull(), t)), F.hex(F.xxhash64(t, doc_id, doc_id.isNull(), F.lit(2)))
    )


def free_names(used: list[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that are not among ``used``, in any case of letters."""
    taken = {c.lower() for c in used}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_table = np.arange(256, dtype=np.uint8)
LOWER = _table.copy()
LOWER[65:91] += 32
_is_space = np.zeros(256, dtype=bool)
_is_space[[0x20, *range(0x09, 0x0E)]] = True
#: Byte classes of lower-cased text; all bytes of a character beyond ASCII are word bytes.
NOT_SPACE = ~_is_space
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_pow: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pow or len(_pow["p"]) < n:
        m = max(n, STEP + (STEP >> 2))
        for k, base in (("p", _P), ("i", _PI)):
            a = np.full(m, base, dtype=np.uint64)
            a[0] = 1
            _pow[k] = np.cumprod(a)
    return _pow["p"], _pow["i"]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column (nulls are empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset :]
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def parts(batches, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about ``limit`` text bytes, one row at least."""
    for b in batches:
        n = np.diff(text_buffer(b.column(column))[1]) + 64
        if not len(n):
            continue
        group = np.cumsum(n) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(n)]
        for i, j in zip(cuts, cuts[1:]):
            yield b.slice(i, j - i)


class Words:
    """Words of a text column: hash, byte start and end of each, and the first word of each row."""

    def __init__(self, col: pa.Array, word_bytes: np.ndarray, prefixes: tuple[int, ...] = ()):
        self.buf, self.off = text_buffer(col)
        low = LOWER[self.buf]
        self.low = low
        is_word = word_bytes[low]
        n = len(low)
        start, end = is_word.copy(), is_word.copy()
        if n:
            start[1:] &= ~is_word[:-1]
            end[:-1] &= ~is_word[1:]
            edges = self.off[(self.off > 0) & (self.off < n)]
            start[edges] = is_word[edges]
            end[edges - 1] = is_word[edges - 1]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)
        self.hash = np.empty(len(self.start), dtype=np.uint64)
        self.prefix = {k: np.zeros(len(self.start), dtype=np.uint64) for k in prefixes}
        at = 0
        while at < len(self.start):
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + STEP, "right")))
            s, e = self.start[at:to], self.end[at:to]
            base = s[0]
            piece = low[base : e[-1]]
            p, inv = powers(len(piece) + 1)
            total = np.empty(len(piece) + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum((piece.astype(np.uint64) + U(1)) * p[: len(piece)], out=total[1:])
            self.hash[at:to] = mix((total[e - base] - total[s - base]) * inv[s - base])
            for k in prefixes:
                cut = np.minimum(s + k, e)
                self.prefix[k][at:to] = mix((total[cut - base] - total[s - base]) * inv[s - base] + U(k))
            at = to

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.count)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word shingles by first word (rows of fewer words give none), and whether each is one."""
        n = len(self.hash)
        h = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            if n > i:
                h[: n - i] = (h[: n - i] + self.hash[i:]) * _P
        left = np.repeat(self.first[1:], self.count) - np.arange(n)
        return mix(h), left >= k


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), type=pa.int64())


def grouped_arrow(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``fn(table) -> RecordBatch or None`` for every group of the (integer) keys, which are the first columns.

    Groups lie side by side in sorted partitions and are sliced off the stream, so many small groups cost little; only
    the group at hand is held. Callers bound the size of a group by dealing blocks."""

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            new = np.zeros(len(t), dtype=bool)
            for i in range(len(keys)):
                k = t.column(i).to_numpy()
                new[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(new).tolist()]
            for a, z in zip(cuts, cuts[1:]):
                if (out := fn(t.slice(a, z - a))) is not None:
                    yield out
            rest = t.slice(cuts[-1])
        if rest is not None and len(rest) and (out := fn(rest)) is not None:
            yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def block_pairs(df: DataFrame, key: str, node: str, block: int) -> DataFrame:
    """``df`` dealt to pairs of blocks: each ``key`` group is cut by a hash of ``node`` into blocks of about ``block``
    rows; adds bi, bj and the row's own ``block``. ``members`` is the group's size."""
    d = df.withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).withColumn(
        "block", F.pmod(F.xxhash64(node, F.lit(3)), F.col("blocks")).cast("int")
    )
    pairs = "transform(sequence(0, blocks - 1), i -> named_struct('bi', least(i, block), 'bj', greatest(i, block)))"
    return d.withColumn("unit", F.explode(F.expr(pairs))).withColumn("bi", F.col("unit.bi")).withColumn("bj", F.col("unit.bj"))
