"""Language-model scoring by context-tree weighting over bytes.

Bytes are decomposed into eight binary decisions (255 nodes of a binary tree).  Each decision has a context tree over the
previous bytes, to depth ``DEPTH``: every context that occurs in the training documents holds the counts (n0, n1) of its
decisions and the Krichevsky-Trofimov block probability of them.  From the deepest contexts up, a node's weighted
probability is half its own and half the product of its children's, so a node's posterior weight of stopping there is
lambda = own / (own + children).  Prediction mixes the KT estimates (n1 + 1/2) / (n0 + n1 + 1) of all depths by these
weights along the context; where a deeper context never occurred, the mixture ends at the last one that did.  A text is
its lower-cased (A-Z) bytes and an end byte 0, after DEPTH bytes 0; its score is the log10 probability of that.

All on the cluster.  Documents are dealt to blocks of about ``BLOCK`` bytes by a hash, one block a partition.  A block reports its distinct byte
strings of DEPTH + 1 and its distinct words, with their counts in training documents; sums over blocks are the corpus
statistics.  Equal rows are merged batch by batch before they are dealt, so a row that is repeated often reaches its block a
few times only; it counts, and is returned, as often as it stands in the input.  The tree is cut at depth ROOT: subtrees (all strings that share their nearest ROOT context bytes) are dealt to
buckets of about KEYS strings, each bucket works its levels up to the roots, the levels above them (at most 256^ROOT
contexts of one decision, whatever the corpus) are worked decision by decision, and what these give the roots goes back
down the subtrees.  Each block gets back the values of what it reported, ahead of its texts in one sorted stream: the
texts are looked up slice by slice as they come, so a task holds the values and one batch of texts, not the block.  Nothing
corpus-sized passes through the driver or is broadcast; no counts are pruned.

The base score's words are without white space; a word is known by its 64-bit hash.

Edge cases: null texts are empty and score the end alone; rows of null doc_id are training rows; an empty training set gives
KT's 1/2 for every decision; repeated rows count and score each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.llm.common import LOWER, NOT_SPACE, U, Words, grouped_arrow, longs, parts, staged, text_buffer
from hourwise.llm.toxicity import held_out

DEPTH, BLOCK = 5, 64 << 20
#: Depth of the subtrees' roots, and keys in a bucket of subtrees.
ROOT, KEYS = 3, 1 << 17
#: Keys that a block gathers at least before it merges them.
PENDING = 1 << 19
#: Text bytes worked at a time.
SLICE = 1 << 18
#: The end token's key among the words.
END = 0x0E4D
#: Kinds of a text in the stream that is scored; 0 and 1 are the values of byte strings and words.
TRAIN, HELD_OUT = 2, 3


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every byte and end: key holds DEPTH bytes of context, the nearest last, and the byte."""
    buf, off = text_buffer(col)
    n, pad = len(off) - 1, DEPTH + 1
    row = np.repeat(np.arange(n), np.diff(off))
    x = np.zeros(len(buf) + pad * n, dtype=np.uint64)
    x[np.arange(len(buf)) + pad * row + DEPTH] = LOWER[buf]
    key = np.zeros(len(x), dtype=np.uint64)
    for i in range(pad):
        key[i:] |= x[: len(x) - i] << U(8 * i)
    owner = np.repeat(np.arange(n), np.diff(off) + pad)
    inside = np.arange(len(x)) - (off[:-1] + pad * np.arange(n))[owner] >= DEPTH
    return owner[inside], key[inside]


def _sums(keys: list[np.ndarray], train: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their sums; the lists are emptied, so that their arrays go as soon as they are joined."""
    k = np.concatenate(keys)
    keys.clear()
    order = np.argsort(k, kind="stable")
    k = k[order]
    t = np.concatenate(train)
    train.clear()
    t = t[order]
    del order
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(t, at) if len(at) else t


def _distinct(key: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts in training rows, which ``train`` repeats so many times."""
    if train.max(initial=0) > 1:
        return _sums([key], [train])
    tagged = (key << U(1)) | train.astype(np.uint64)
    v, c = np.unique(tagged, return_counts=True)
    return _sums([v >> U(1)], [np.where(v & U(1), c, 0).astype(np.int64)])


def _merged(batches):
    """Equal rows of a batch as one row with ``times``."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(b.schema.names, use_threads=False).aggregate([([], "count_all")])
        yield from t.select([*b.schema.names, "count_all"]).rename_columns([*b.schema.names, "times"]).to_batches()


def _report(batches):
    """(kind, key, block, train) of each block; blocks lie side by side."""
    block, got = None, {0: ([], []), 1: ([], [])}

    def flush():
        for kind, (k, t) in got.items():
            if k:
                key, train = _sums(k, t)
                for a in range(0, len(key), 100_000):
                    z = min(len(key), a + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(z - a, kind, np.int32)), longs(key[a:z]), pa.array(np.full(z - a, block, np.int32)), longs(train[a:z])],
                        ["kind", "key", "block", "train"],
                    )

    for part in parts(batches, limit=SLICE):
        ids = part.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for a, z in zip(cuts, cuts[1:]):
            b = part.slice(a, z - a)
            if block is not None and ids[a] != block:
                yield from flush()
            block = int(ids[a])
            held = np.asarray(b.column("held_out").to_numpy(zero_copy_only=False), dtype=bool)
            learn = np.where(held, 0, b.column("times").to_numpy()).astype(np.int64)
            row, key = grams(b.column("text"))
            k, t = _distinct(key, learn[row])
            got[0][0].append(k), got[0][1].append(t)
            w = Words(b.column("text"), NOT_SPACE)
            v, c = _sums([np.concatenate([w.hash, np.full(len(learn), END, np.uint64)])], [np.concatenate([learn[w.row], learn])])
            got[1][0].append(v), got[1][1].append(c)
            for k, t in got.values():
                if sum(map(len, k[1:])) > max(PENDING, len(k[0])):  # [0] holds what is merged
                    for kept, merged in zip((k, t), _sums(k, t)):
                        kept.append(merged)
    yield from flush()


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x >= 1/2: Stirling's series at x + 6."""
    y = x + 6
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def _log_kt(n: np.ndarray) -> np.ndarray:
    """Log of the KT block probability of counts (rows n0, n1)."""
    a = n + 0.5
    return _lgamma(a[0]) + _lgamma(a[1]) - _lgamma(a[0] + a[1]) - math.log(math.pi)


class Level:
    """Nodes of one depth, sorted: keys, counts (rows n0, n1), log weighted probability, weight of stopping."""

    def __init__(self, node: np.ndarray, n: np.ndarray, lw: np.ndarray, stay: np.ndarray):
        self.node, self.n, self.lw, self.stay = node, n, lw, stay
        self.up = np.zeros(0, np.int64)

    def parents(self, depth: int) -> Level:
        """The level above, at ``depth``; ``up`` becomes each node's place there."""
        # a key's low byte is the decision, the bytes above it are the context from the nearest on
        node, self.up = np.unique(self.node & U((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        n = np.stack([np.bincount(self.up, x, len(node)) for x in self.n])
        below, kt = np.bincount(self.up, self.lw, len(node)), _log_kt(n)
        return Level(node, n, np.logaddexp(kt, below) - math.log(2), 1 / (1 + np.exp(np.minimum(700.0, below - kt))))

    def mixture(self, mixed: np.ndarray, left: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a node gives its children, from what its parent gives it: the estimates mixed so far, the weight left,
        and the probability of bit 1 where the context is known to here only (nodes without counts inherit it)."""
        total = self.n.sum(axis=0)
        one = (self.n[1] + 0.5) / (total + 1)
        return mixed + left * self.stay * one, left * (1 - self.stay), np.where(total > 0, mixed + left * one, p)


def _levels(node: np.ndarray, n: np.ndarray, lw: np.ndarray, top: int, depth: int) -> list[Level]:
    """Levels ``top`` to ``depth`` over the (sorted) nodes of the deepest."""
    levels = [Level(node, n, lw, np.ones(len(node)))]
    for d in range(depth - 1, top - 1, -1):
        levels.insert(0, levels[0].parents(d))
    return levels


def _down(levels: list[Level], given: tuple, below: Level | None = None) -> tuple:
    """``given`` to the first level's nodes, carried to the last's children, or handed out to the nodes of ``below``."""
    for level, after in zip(levels, [*levels[1:], below]):
        given = level.mixture(*given)
        if after is not None:
            given = tuple(x[after.up] for x in given)
    return given


def _leaves(key: np.ndarray, count: np.ndarray, j: int) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """Levels ROOT to DEPTH of whole subtrees, for the keys' decisions number ``j`` of eight, whose trees share no node with
    the others': each key's place in the deepest level, and the bit taken."""
    bit = (key >> U(7 - j) & U(1)).astype(bool)
    node, at = np.unique(key & ~U(255) | U(1 << j) | (key & U(255)) >> U(8 - j), return_inverse=True)
    n = np.stack([np.bincount(at, np.where(bit == b, count, 0), len(node)) for b in (False, True)])
    return _levels(node, n, _log_kt(n), ROOT, DEPTH), at, bit


def _uints(t, name: str) -> np.ndarray:
    return t.column(name).to_numpy().view(np.uint64)


def _roots(t):
    """The nodes at depth ROOT of a bucket of subtrees."""
    key, count = _uints(t, "key"), t.column("n").to_numpy()
    tops = []
    for j in range(8):
        top = _leaves(key, count, j)[0][0]
        columns = [pa.array((top.node & U(255)).astype(np.int32)), longs(top.node), longs(top.n[0]), longs(top.n[1]), pa.array(top.lw)]
        tops.append(pa.RecordBatch.from_arrays(columns, ["decision", "node", "n0", "n1", "lw"]))
    return pa.concat_batches(tops)


def _upper(t):
    """What the levels above ROOT give the nodes at ROOT, for the one context tree of a decision."""
    node = _uints(t, "node")
    order = np.argsort(node)
    n = np.stack([t.column(c).to_numpy().astype(np.float64) for c in ("n0", "n1")])
    levels = _levels(node[order], n[:, order], t.column("lw").to_numpy()[order], 0, ROOT)
    root = np.ones(len(levels[0].node))
    mixed, left, p = _down(levels[:-1], (root * 0, root, root / 2), levels[-1])
    return pa.RecordBatch.from_arrays([longs(levels[-1].node), pa.array(mixed), pa.array(left), pa.array(p)], ["node", "mixed", "left", "p"])


def _bytes(bucket, keys, roots):
    """(key, value): log10 probability of the key's byte after its context, for a bucket of subtrees."""
    key, count = _uints(keys, "key"), keys.column("n").to_numpy()
    node = _uints(roots, "node")
    value = np.empty((len(key), 8))
    for j in range(8):
        levels, at, bit = _leaves(key, count, j)
        mine = np.flatnonzero((node & U(255)) >> U(j) == 1)
        order = mine[np.argsort(node[mine])]
        p = _down(levels, tuple(roots.column(c).to_numpy()[order] for c in ("mixed", "left", "p")))[2][at]
        value[:, j] = np.log10(np.where(bit, p, 1 - p))
    return pa.table([longs(key), pa.array(value.sum(axis=1))], ["key", "value"])


def byte_scores(keys: DataFrame) -> DataFrame:
    """(key, value) for each row of ``keys`` (key, n): its log10 probability under the tree of the counts n."""
    buckets = 1 + keys.count() // KEYS

    def bucket(node: str):
        return F.expr(f"cast(pmod(xxhash64(shiftright({node}, 8) & {(1 << 8 * ROOT) - 1}L), {buckets}) as int)")

    dealt = keys.select(bucket("key").alias("bucket"), "key", "n")
    roots = staged(grouped_arrow(dealt, ["bucket"], _roots, "decision int, node long, n0 long, n1 long, lw double"))
    top = staged(grouped_arrow(roots, ["decision"], _upper, "node long, mixed double, left double, p double"))
    top = top.withColumn("bucket", bucket("node"))
    return dealt.groupBy("bucket").cogroup(top.groupBy("bucket")).applyInArrow(_bytes, "key long, value double")


class Values:
    """What a block reported, by key: gathered as it comes, sorted when it is first looked up."""

    def __init__(self):
        self.keys, self.values = [np.zeros(0, np.uint64)], [np.zeros(0)]

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        self.keys.append(key.copy()), self.values.append(value.copy())  # a view would keep its whole batch

    def of(self, key: np.ndarray) -> np.ndarray:
        if len(self.keys) > 1:
            k, v = np.concatenate(self.keys), np.concatenate(self.values)
            self.keys.clear(), self.values.clear()
            order = np.argsort(k)
            self.keys, self.values = [k[order]], [v[order]]
        return self.values[0][np.searchsorted(self.keys[0], key)] if len(key) else np.zeros(0)


def _score(total: int, kinds: int):
    """Scores from batches in which each block's values (kinds 0 and 1) stand before its texts, which are not held."""

    def score(b: pa.RecordBatch, byte: Values, word: Values) -> pa.RecordBatch:
        row, g = grams(b.column("text"))
        order = np.argsort(g)  # looked up in order, so that the table is read in order
        score = np.bincount(row[order], byte.of(g[order]), len(b))
        w = Words(b.column("text"), NOT_SPACE)
        end = word.of(np.array([END], np.uint64))[0]
        c = word.of(w.hash)
        log = np.log10((np.append(c, end) + 1) / (total + kinds + 1))
        base = np.bincount(w.row, log[:-1], len(b)) + log[-1]
        n_known = np.bincount(w.row, c > 0, len(b)) + (end > 0)
        return pa.RecordBatch.from_arrays(
            [b.column("key"), pa.array(b.column("kind").to_numpy() == HELD_OUT), longs(w.count + 1), longs(n_known),
             longs(np.full(len(b), total)), pa.array(base), pa.array(score), longs(b.column("value").to_numpy())],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "times"],
        )

    def run(batches):
        block = None
        for b in batches:
            ids, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(ids) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(ids)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if block != ids[a]:
                    block, values = ids[a], (Values(), Values())
                part = b.slice(a, z - a)
                if kind[a] < TRAIN:
                    values[kind[a]].add(part.column("key").to_numpy().view(np.uint64), part.column("value").to_numpy())
                else:
                    yield from (score(p, *values) for p in parts([part], limit=SLICE))

    return run


_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, times long"


def score_texts(docs: DataFrame, folds: int = 7) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = text.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0  # one number
    blocks = 1 + size // BLOCK
    d = text.withColumn("held_out", held_out(F.col("doc_id"), folds)).withColumn(
        "block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    )
    d = d.mapInArrow(_merged, "doc_id long, text string, held_out boolean, block int, times long")
    seen = staged(
        d.repartitionById(blocks, "block").mapInArrow(_report, "kind int, key long, block int, train long")
    )
    totals = seen.groupBy("kind", "key").agg(F.sum("train").alias("n"))
    keys = staged(totals.where("kind = 0").select("key", "n"))
    words = staged(totals.where("kind = 1").select("key", F.col("n").cast("double").alias("value")))
    size = words.agg(F.coalesce(F.sum("value"), F.lit(0.0)).cast("long"), F.count(F.expr("if(value > 0, 1, null)"))).first()
    values = staged(byte_scores(keys)).withColumn("kind", F.lit(0)).unionByName(words.withColumn("kind", F.lit(1)))
    known = staged(seen.select("kind", "key", "block").join(values, ["kind", "key"]))
    # one stream a block, the values first: texts are scored as they come, so a task holds a block's values and a slice of text
    texts = d.select(
        "block", F.when(F.col("held_out"), HELD_OUT).otherwise(TRAIN).alias("kind"), F.col("doc_id").alias("key"),
        F.col("times").cast("double").alias("value"), "text",
    )
    stream = known.select("block", "kind", "key", "value", F.lit(None).cast("string").alias("text")).unionByName(texts)
    scored = (
        stream.repartitionById(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(_score(size[0], size[1]), _SCHEMA)
    )
    each = scored.withColumn("copy", F.explode(F.expr("array_repeat(0, int(times))")))  # a batch's rows at most
    return each.drop("copy", "times")
