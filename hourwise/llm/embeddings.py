"""Embedding near-dedup with cross-polytope hashing.

A hash is the nearest vertex (signed axis) of a vector after three rounds of random signs and a fast Hadamard transform;
``HASHES`` hashes make a bucket of one table; the number of tables follows from the dimension and the threshold, so that
pairs at the threshold are found as often in wide vectors as in narrow ones.  Each vector lives in its home bucket of a table and probes
``HASHES`` more, in each of which one hash takes its second nearest vertex.  A pair meets in a bucket that is home to one
of them and home to or probed by the other, and is verified by its cosine in double precision.

Equal vectors are one node with a multiplicity.  Buckets are cut into blocks of ``BLOCK`` vectors; units are pairs of
blocks, so no bucket is one task.  Vectors are hashed once and carry their vertices; from these a unit sees in which bucket a
pair meets first, and counts it there only.  Units return one row
for each vector with links: the number of its links there and the smallest vector that it reaches inside the unit, not
the pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
component; vectors of different lengths never link; repeated rows are linked copies; rows of null vec_id never name a
component unless all do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from hourwise.llm.common import U, block_pairs, grouped_arrow, longs, mix, staged
from hourwise.llm.components import components

#: Least number of tables, hashes in a bucket, vectors in a block.
TABLES, HASHES, BLOCK, SEED = 12, 3, 256, 5
#: Share of the pairs at the threshold that all tables may miss, and the fitted chance that a pair of cosine c meets in one
#: table of d dimensions (a power of two): MEET * d ** (-SLOPE * (1 - c) / (1 + c)).
MISS, MEET, SLOPE = 0.02, 0.86, 5.0


def _matrix_of(size: int) -> np.ndarray:
    m = np.ones((1, 1))
    while len(m) < size:
        m = np.block([[m, m], [m, -m]])
    return m


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast transform of the rows, four levels of butterflies at a time."""
    n, d = x.shape
    done = 1
    while done < d:
        size = min(16, d // done)
        x = np.matmul(_matrix_of(size), x.reshape(-1, size, done))
        done *= size
    return x.reshape(n, d)


def _padded(dim: int) -> int:
    """The power of two that vectors are padded to; in fewer than 32 dimensions random signs give too few rotations."""
    return 1 << max(5, (dim - 1).bit_length())


def tables(dim: int, threshold: float) -> int:
    """Tables that miss at most ``MISS`` of the pairs at the threshold, from the chance that such a pair meets in one."""
    meet = MEET * _padded(dim) ** (-SLOPE * (1 - threshold) / (1 + threshold))
    return max(TABLES, math.ceil(math.log(MISS) / math.log1p(-meet)))


def vertices(x: np.ndarray, n_tables: int) -> np.ndarray:
    """The nearest and the second nearest vertex of unit vectors: rows x tables x HASHES x 2."""
    n, d0 = x.shape
    d = _padded(d0)
    x = np.pad(x, ((0, 0), (0, d - d0)))
    rng = np.random.default_rng(SEED)
    out = np.empty((n, n_tables, HASHES, 2), dtype=_width(d0))
    r = np.arange(n)
    for t in range(n_tables):
        for h in range(HASHES):
            y = x
            for _ in range(3):
                y = _hadamard(y * rng.choice([-1.0, 1.0], size=d))
            a = np.abs(y)
            for rank in range(2):
                i = a.argmax(axis=1)
                out[:, t, h, rank] = 2 * i + (y[r, i] < 0)
                a[r, i] = -1
    return out


def _width(dim: int) -> str:
    return "<u2" if dim <= 1 << 15 else "<u4"


def buckets(v: np.ndarray, dim: int, probes: bool = True) -> np.ndarray:
    """Bucket keys (rows x tables x (1 + HASHES)) of ``vertices``: the home bucket first, then the probes, if wanted."""
    n, n_tables = v.shape[:2]
    out = np.empty((n, n_tables, 1 + HASHES * probes), dtype=np.uint64)
    for probe in range(out.shape[2]):
        k = np.full((n, n_tables), dim << 20, dtype=np.uint64) + np.arange(n_tables, dtype=np.uint64)
        for h in range(HASHES):
            k = mix(k * U(0x9E3779B97F4A7C15) + v[:, :, h, int(probe == h + 1)].astype(np.uint64))
        out[:, :, probe] = k
    return out


def _meeting(v: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of rows the first table in which they meet (-1: none), and whether that is in i's home (else in j's)."""
    first, at_i = np.full(len(i), -1), np.zeros(len(i), dtype=bool)
    for t in range(v.shape[1]):
        left = np.flatnonzero(first < 0)
        if not len(left):
            break
        a, b = v[i[left], t], v[j[left], t]
        off = a[:, :, 0] != b[:, :, 0]
        n_off = off.sum(axis=1)
        to_i, to_j = ((n_off == 0) | ((n_off == 1) & (off & (x[:, :, 1] == y[:, :, 0])).any(axis=1)) for x, y in ((b, a), (a, b)))
        met = to_i | to_j
        first[left[met]], at_i[left[met]] = t, to_i[met]
    return first, at_i


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _sign(threshold: float):
    """Adds ``sig``, the vertices of each vector."""

    def run(batches):
        for b in batches:
            size = b.column("dim").to_numpy()
            for d in np.unique(size):
                some = b.take(pa.array(np.flatnonzero(size == d)))
                v = vertices(_matrix(some.column("embedding")), tables(int(d), threshold))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([x.tobytes() for x in v], pa.binary())], [*some.schema.names, "sig"])

    return run


def _signatures(col, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(col.to_pylist()), dtype=_width(dim)).reshape(len(col), -1, HASHES, 2)


def _keys(batches):
    for b in batches:
        size = b.column("dim").to_numpy()
        for d in np.unique(size):
            at = pa.array(np.flatnonzero(size == d))
            k = buckets(_signatures(b.column("sig").take(at), int(d)), int(d))
            home = np.zeros(k.shape, dtype=bool)
            home[:, :, 0] = True
            yield pa.RecordBatch.from_arrays(
                [longs(k.reshape(-1)), pa.array(home.reshape(-1)), b.column("node").take(pa.array(np.repeat(at.to_numpy(), k[0].size)))],
                ["bkey", "home", "node"],
            )


def _compare(threshold: float):
    def run(t: pa.Table):
        bkey, bi, bj = (t.column(i)[0].as_py() for i in range(3))
        t = t.sort_by("node")
        block, home = t.column("block").to_numpy(), t.column("home").to_numpy()
        if len(t) < 2 or not home.any():
            return None
        x = _matrix(t.column("embedding"))
        cos = x @ x.T
        i, j = np.nonzero(np.triu(cos >= threshold, 1))  # rows are sorted by node: i has the smaller one
        ok = ((block[i] == bi) & (block[j] == bj)) | ((block[i] == bj) & (block[j] == bi))
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        # a pair counts in the first table in which it meets, and there in i's home before j's
        dim = int(t.column("dim")[0].as_py())
        v = _signatures(t.column("sig"), dim)
        home = buckets(v, dim, probes=False)[:, :, 0]
        first, at_i = _meeting(v, i, j)
        keep = (first >= 0) & (home[np.where(at_i, i, j), first] == np.uint64(bkey & (2**64 - 1)))
        i, j = i[keep], j[keep]
        if not len(i):
            return None
        mult = t.column("mult").to_numpy()
        links = np.bincount(i, mult[j], len(t)) + np.bincount(j, mult[i], len(t))
        low = np.arange(len(t))
        while True:
            before = low.copy()
            np.minimum.at(low, i, low[j])
            np.minimum.at(low, j, low[i])
            if (low == before).all():
                break
        some = np.flatnonzero(links)
        node = t.column("node").combine_chunks()
        return pa.RecordBatch.from_arrays(
            [node.take(pa.array(some)), longs(links[some]), node.take(pa.array(low[some]))], ["node", "links", "root"]
        )

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    e = F.col("embedding")
    fine = F.coalesce(
        (F.size(e) > 0)
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(e, lambda x: x != 0),
        F.lit(False),
    )
    key = F.concat(F.hex(F.xxhash64(F.lit(1), e)), F.hex(F.xxhash64(e, F.lit(2))))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("node", F.when(fine, key))
    distinct = (
        v.where("node is not null").groupBy("node")
        .agg(F.first("embedding").alias("embedding"), F.count("*").alias("mult")).withColumn("dim", F.size("embedding"))
    )
    nodes = staged(distinct.mapInArrow(_sign(threshold), StructType([*distinct.schema.fields, StructField("sig", BinaryType())])))
    member = staged(nodes.select("node", "dim", "sig").mapInArrow(_keys, "bkey long, home boolean, node string"))
    size = member.groupBy("bkey").agg(F.count("*").alias("members"), F.max("home").alias("any")).where("members > 1 and any")
    units = block_pairs(member.join(size.select("bkey", "members"), "bkey"), "bkey", "node", BLOCK).join(nodes, "node")
    found = staged(
        grouped_arrow(
            units.select("bkey", "bi", "bj", "block", "home", "node", "mult", "dim", "sig", "embedding"), ["bkey", "bi", "bj"],
            _compare(threshold), "node string, links long, root string",
        )
    )
    count = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select("node", "root"), "node", "root")
    info = (
        nodes.select("node", "mult").join(count, "node", "left").join(comp, "node", "left")
        .select("node", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    rows = v.select("vec_id", "node").where("node is not null").join(info, "node")
    low = rows.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    alone = v.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.join(low, "component").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
