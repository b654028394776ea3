"""MinHash near-dedup with HyperMinHash registers.

A document's set is its distinct 5-word shingles (lower-cased A-Z, words without white space; fewer words: the
whole sequence as one).  Each set is compressed to ``REGISTERS`` registers of 16 bits: a shingle's hash picks one
register, the smallest remaining value per register is kept as a leading-zero count (6 bits) plus a mantissa
(10 bits).  Registers that no shingle picked copy another register of the same set, chosen by a fixed pseudo-random
probe order, so that small sets band as well as large ones.  ``BANDS`` bands of ``ROWS`` registers retrieve
candidates; a pair at the threshold 0.85 shares none with probability (1 - 0.85^5)^24 < 1e-6.

Equal sets are one node from the start.  Pairs pass a length bound and the collision-corrected estimate, then are confirmed on
the full sets; work on a bucket is cut into blocks of ``BLOCK`` members, so a hot bucket is spread.

1. Hubs.  Every bucket names up to ``PIVOTS`` members whose registers agree most with those of the others: each block puts forward
   its best by the most frequent value of each register, and the best of the blocks serve the whole bucket.  Each member meets
   these only, so pairs grow in proportion to the members, and the original behind a group of near copies links most of them.
   The components are contracted.
2. Rest.  In the buckets that still hold several components, shingles that no other member of such buckets has are counted.
   They cannot be shared, so two sets with p and q shingles left overlap by min(p, q) at most: sets with too few left are out, and
   so are pairs whose sizes ask for more.  (Copies with edits of their own, too far from their original, are of this kind: they
   are near each other in the estimate, but not over the threshold.)  Every pair that remains is compared, by pairs of blocks,
   so no link that could join two components is skipped.

Edge cases: null or empty texts and texts without words have an empty set, link with nothing and keep their own
id as component; repeated rows share a set; rows of null doc_id never name a component unless all do (then null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourwise.llm.common import NOT_SPACE, U, Words, block_pairs, grouped_arrow, longs, mix, parts, staged
from hourwise.llm.components import components

REGISTERS, BANDS, ROWS, MANTISSA = 120, 24, 5, 10
BLOCK = 256
PIVOTS = 3
#: Standard errors that the estimate may fall short; used for sets of at least 64 shingles only.
SLACK = 5.0
_PROBES = mix(np.arange(REGISTERS * 512, dtype=np.uint64) + U(77)).reshape(512, REGISTERS) % U(REGISTERS)


def _doc_sets(w: Words, k: int) -> list[np.ndarray]:
    h, whole = w.shingles(k)
    out = []
    for i in range(len(w.count)):
        a, b = w.first[i], w.first[i + 1]
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            v = np.array([b - a], dtype=np.uint64)
            for x in w.hash[a:b]:
                v = mix(v * U(0x9E3779B97F4A7C15) + x)
            out.append(v)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def registers(s: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of a non-empty set of 64-bit hashes."""
    h = mix(s + U(0x5851F42D4C957F2D))
    bucket = (h >> U(40)) % U(REGISTERS)
    rest = mix(h ^ U(0xA0761D6478BD642F))
    low = np.full(REGISTERS, 2**64 - 1, dtype=np.uint64)
    np.minimum.at(low, bucket.astype(np.int64), rest)
    # leading zeros of the upper 53 bits, exact in doubles; the mantissa are the bits after the leading one
    top = (low >> U(11)).astype(np.float64)
    m, e = np.frexp(np.maximum(top, 1.0))
    zeros = np.minimum(53 - e, 62).astype(np.uint16)
    regs = (zeros << MANTISSA) | ((m * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)
    full = np.zeros(REGISTERS, dtype=bool)
    full[bucket.astype(np.int64)] = True
    out, todo = regs.copy(), np.flatnonzero(~full)
    for probe in _PROBES:
        if not len(todo):
            break
        pick = probe[todo].astype(np.int64)
        ok = full[pick]
        out[todo[ok]] = regs[pick[ok]]
        todo = todo[~ok]
    if len(todo):
        out[todo] = regs[np.flatnonzero(full)[0]]
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    r = regs.reshape(BANDS, ROWS).astype(np.uint64)
    v = np.arange(1, BANDS + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93)
    for j in range(ROWS):
        v = mix(v ^ r[:, j]) + U(j)
    return mix(v)


def node_of(s: np.ndarray) -> bytes:
    """128-bit digest of a set, whatever the order."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ U(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)]).tobytes()


def _sketch(k: int):
    def run(batches):
        for b in parts(batches):
            w = Words(b.column("text"), NOT_SPACE)
            sets = _doc_sets(w, k)
            regs = [registers(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("rk"),
                    b.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([r.tobytes() if r is not None else None for r in regs], pa.binary()),
                ],
                ["rk", "doc_id", "n", "node", "regs"],
            )

    return run


def _sets(k: int):
    def run(batches):
        for b in parts(batches):
            sets = _doc_sets(Words(b.column("text"), NOT_SPACE), k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["node", "shingles"],
            )

    return run


def _explode_bands(batches):
    for b in batches:
        regs = b.column("regs").to_pylist()
        keys = [bands(np.frombuffer(r, dtype=np.uint16)) for r in regs]
        yield pa.RecordBatch.from_arrays(
            [
                longs(np.concatenate(keys) if keys else np.zeros(0, np.uint64)),
                b.column("node").take(pa.array(np.repeat(np.arange(len(regs)), BANDS))),
            ],
            ["bkey", "node"],
        )


def estimate_floor(threshold: float, filled: np.ndarray) -> np.ndarray:
    """Matching registers a pair at the threshold keeps but for ``SLACK`` standard errors; corrected for collisions:
    two different minima agree by chance with probability of about 2^-MANTISSA / 3.  Registers that are copies of others
    (``filled`` are not) tell nothing new, so the error is that of the filled ones."""
    chance = 2.0**-MANTISSA / 3
    share = threshold + (1 - threshold) * chance
    return REGISTERS * (share - SLACK * np.sqrt(share * (1 - share) / np.maximum(filled, 1)))


class Members:
    """Rows of a unit: registers, bucket keys, sizes and components as arrays."""

    def __init__(self, t: pa.Table):
        self.node = t.column("node").combine_chunks()
        raw = t.column("regs").combine_chunks()
        self.regs = np.frombuffer(raw.buffers()[2], dtype=np.uint16)
        first = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset] // 2
        self.regs = self.regs[first : first + len(t) * REGISTERS].reshape(len(t), REGISTERS)
        self.n = t.column("n").to_numpy()
        # distinct values: filled registers, or a few less
        self.filled = (np.diff(np.sort(self.regs, axis=1), axis=1) != 0).sum(axis=1) + 1

    def near(self, i: int, js: np.ndarray, percent: int) -> np.ndarray:
        """Those of ``js`` whose size and estimate allow a link with ``i``."""
        js = js[100 * np.minimum(self.n[js], self.n[i]) >= percent * np.maximum(self.n[js], self.n[i])]
        hits = (self.regs[js] == self.regs[i]).sum(axis=1)
        floor = estimate_floor(percent / 100, np.minimum(self.filled[js], self.filled[i]))
        return js[(hits >= floor) | (np.minimum(self.n[js], self.n[i]) < 64)]

    def pairs(self, found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch | None:
        found = [(i, js) for i, js in found if len(js)]
        if not found:
            return None
        a = np.concatenate([np.full(len(js), i) for i, js in found])
        b = np.concatenate([js for _, js in found])
        return pa.RecordBatch.from_arrays([self.node.take(pa.array(a)), self.node.take(pa.array(b))], ["a", "b"])


def _forward(t: pa.Table) -> pa.RecordBatch:
    """The members of one block that agree most with it: (bkey, node, regs, n, score)."""
    m = Members(t)
    ordered = np.sort(m.regs, axis=0)
    # the longest run of equal values of each register
    new = np.vstack([np.ones((1, REGISTERS), dtype=bool), ordered[1:] != ordered[:-1]])
    rank = np.arange(len(t))[:, None]
    run = rank - np.maximum.accumulate(np.where(new, rank, 0), axis=0)
    mode = ordered[run.argmax(axis=0), np.arange(REGISTERS)]
    score = (m.regs == mode).sum(axis=1)
    best = pa.array(np.argsort(-score, kind="stable")[:PIVOTS])
    return pa.RecordBatch.from_arrays(
        [t.column("bkey").combine_chunks().take(best), m.node.take(best), t.column("regs").combine_chunks().take(best),
         t.column("n").combine_chunks().take(best), longs(score).take(best)], ["bkey", "node", "regs", "n", "score"])


def _with_hubs(percent: int):
    """Unit: a block of a bucket and the bucket's hubs."""

    def run(t):
        m = Members(t)
        hub = t.column("hub").to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(~hub)
        same = m.node.to_numpy(zero_copy_only=False)
        return m.pairs([(i, (js := m.near(i, rows, percent))[same[js] != same[i]]) for i in np.flatnonzero(hub).tolist()])

    return run


def _rest(percent: int):
    """Unit: two blocks of one bucket. Pairs of different components whose first common band is this bucket's."""

    def run(t):
        bkey, bi, bj = (t.column(i)[0].as_py() for i in range(3))
        m = Members(t)
        keys = np.stack([bands(r) for r in m.regs])
        shared = t.column("shared").to_numpy()
        comp = t.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        block = t.column("block").to_numpy()
        at_j = np.flatnonzero(block == bj)
        mine = np.uint64(bkey & (2**64 - 1))
        found = []
        for i in np.flatnonzero(block == bi).tolist():
            js = at_j[(at_j > i) & (comp[at_j] != comp[i])] if bi == bj else at_j[comp[at_j] != comp[i]]
            js = js[(100 + percent) * np.minimum(shared[js], shared[i]) >= percent * (m.n[js] + m.n[i])]
            if len(js):
                js = m.near(i, js, percent)
                same = (keys[js] == keys[i]).argmax(axis=1)  # they share this band, so the first common one exists
                found.append((i, js[keys[i][same] == mine]))
        return m.pairs(found)

    return run


def _sizes(member: DataFrame) -> DataFrame:
    """Buckets of several components: bkey, members."""
    size = member.groupBy("bkey").agg(F.count("*").alias("members"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return size.where("lo <> hi").select("bkey", "members")


def _hub_pairs(member: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Candidates of members with the hubs of their buckets."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = member.join(_sizes(member.withColumn("comp", F.col("node"))), "bkey").withColumn(
        "block", F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int"))
    rows = staged(dealt.join(nodes, "node").select("bkey", "block", "node", "n", "regs", blocks.alias("blocks")))
    schema = "bkey long, node binary, regs binary, n long, score long"
    forward = grouped_arrow(rows.select("bkey", "block", "node", "n", "regs"), ["bkey", "block"], _forward, schema)
    place = Window.partitionBy("bkey").orderBy(F.desc("score"), "node")
    hubs = forward.withColumn("place", F.row_number().over(place)).where(F.col("place") <= PIVOTS)
    # a bucket's hubs go to each of its blocks: PIVOTS rows a block
    each = rows.groupBy("bkey").agg(F.max("blocks").alias("blocks")).join(hubs, "bkey").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = rows.select("bkey", "block", "node", "n", "regs", F.lit(False).alias("hub")).unionByName(
        each.select("bkey", "block", "node", "n", "regs", F.lit(True).alias("hub")))
    return grouped_arrow(units, ["bkey", "block"], _with_hubs(percent), "a binary, b binary")


def _rest_pairs(member: DataFrame, nodes: DataFrame, sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Candidates among the components that are still apart."""
    m = member.join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    m = staged(m.join(_sizes(m).select("bkey"), "bkey", "left_semi"))
    left = m.select("node").distinct()
    # shingles of one node only, by node: both aggregates combine in the tasks first
    single = (
        sets.join(left, "node").select("node", F.explode("shingles").alias("shingle")).groupBy("shingle")
        .agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("single"))
    )
    info = staged(
        nodes.join(left, "node", "left_semi").join(single, "node", "left")
        .withColumn("shared", F.col("n") - F.coalesce("single", F.lit(0))).drop("single")
        .where(100 * F.col("shared") >= percent * F.col("n"))
    )
    m = m.join(info.select("node"), "node", "left_semi")
    dealt = block_pairs(m.join(_sizes(m), "bkey"), "bkey", "node", BLOCK).join(info, "node")
    units = dealt.select("bkey", "bi", "bj", "node", "comp", "block", "n", "shared", "regs")
    return grouped_arrow(units, ["bkey", "bi", "bj"], _rest(percent), "a binary, b binary")


def _verified(cand: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        cand.join(one, "a")
        .join(two, "b")
        .where(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
        .select("a", "b")
    )


def components_of(docs: DataFrame, key: Column | None = None, k: int = 5, percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; more columns are ignored): rk (the row's ``key``), doc_id, n, the set's
    128-bit digest ``node`` and the least digest ``component`` of its group (both null for an empty set)."""
    rk = F.lit(None).cast("string") if key is None else key
    text = docs.select(rk.alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = staged(text.mapInArrow(_sketch(k), "rk string, doc_id long, n long, node binary, regs binary"))
    nodes = sketch.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("regs").alias("regs"))
    keyed = nodes.select("node", "regs").mapInArrow(_explode_bands, "bkey long, node binary")
    shared = keyed.groupBy("bkey").agg(F.count("*").alias("c")).where("c > 1").select("bkey")
    member = staged(keyed.join(shared, "bkey", "left_semi"))
    wanted = member.select("node").distinct()
    sets = staged(
        text.select("text").mapInArrow(_sets(k), "node binary, shingles array<long>")
        .join(wanted, "node", "left_semi")
        .dropDuplicates(["node"])
    )
    nodes = staged(nodes.join(wanted, "node", "left_semi"))
    found = _verified(staged(_hub_pairs(member, nodes, percent).distinct()), sets, percent)
    comp = components(found)
    links = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
    rest = _verified(staged(_rest_pairs(member, nodes, sets, comp, percent).distinct()), sets, percent)
    comp = components(rest.unionByName(links))
    labelled = sketch.select("rk", "doc_id", "n", "node").join(comp, "node", "left")
    return labelled.withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; more columns are ignored): doc_id, n_shingles, component_id, kept,
    and the set's 128-bit digest ``node`` (null for an empty set)."""
    labelled = components_of(docs, None, k, percent).drop("rk")
    # a row without words is a group of its own
    group = labelled.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    full = labelled.where("n > 0").join(group, "component").unionByName(
        labelled.where("n = 0").withColumn("component_id", F.col("doc_id"))
    )
    return full.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
        "node",
    )
