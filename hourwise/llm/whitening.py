"""Embedding whitening by Jacobi-Davidson.

A vector's entries c become whole numbers x = floor(``SCALE`` * c); the fit list holds each distinct x vector once.  The leading
eigenvectors of the fit list's covariance (divisor n) are found without ever forming it: Spark only computes products
``sum z (z . p) / n`` of centred vectors z = x - S/n with a few vectors p at a time, one job each, over blocks of the staged
fit list.  What returns to the driver is a few vectors of the embeddings' length for each task, ``PARTS`` partial sums at most.

Each outer round extracts Ritz pairs from the search space (Rayleigh-Ritz), locks leading pairs whose residual is at rounding
level, and extends the space by approximate solutions of the projected correction equations
(I - QQ')(A - theta I)(I - QQ') t = -r, Q holding the locked vectors and the pair's own.  The equations of all open pairs are
solved by MINRES side by side, so one job serves all of them.  The space is cut back to the leading Ritz vectors when full.
A last job takes the residuals of the locked vectors afresh.

Numbers: S, n and each row's deviation are exact (128-bit parts, Python integers); the rest is double precision.

Edge cases: rows whose vector is null, empty or holds null or non-finite entries are dropped, as are rows whose length is not
the most frequent one (ties: the longer); entries beyond the range of a long saturate; repeated rows count once in the fit list
and get the same numbers; a deviation beyond a long is null; components without variance (constant vectors, fewer than two
distinct ones, more components than dimensions) are not returned; signs are set so that a vector's largest entry is positive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.llm.common import staged

SCALE, COMPONENTS = 256.0, 4
#: Entries of one block of vectors, and of the blocks that one task reads where there are more of them.
BLOCK, TASK = 1 << 20, 1 << 22
#: Partial sums that return to the driver from one job at most.
PARTS = 64
#: Steps of the inner MINRES, and vectors of the search space beyond the wanted ones at most and after a cut.
INNER, SPACE, KEEP = 6, 24, 6
ROUNDS = 200


def whole(col: pa.Array) -> np.ndarray:
    """Entries floor(SCALE * c) as longs, rows x dimensions."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    c = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    with np.errstate(over="ignore"):
        f = np.floor(SCALE * c)
    out = np.clip(f, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    out[f >= 2.0**63] = 2**63 - 1
    return out


def _whole_rows(batches):
    for b in batches:
        x = whole(b.column("embedding"))
        off = pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)) if len(x) else pa.array([0], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(off, pa.array(x.reshape(-1)))], ["x"])


def _blocks(batches):
    """Blocks of vectors: their number, their longs as bytes, and their sums as upper and lower halves."""
    for b in batches:
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
        step = max(1, BLOCK // max(1, x.shape[1]))
        for i in range(0, len(x), step):
            y = np.ascontiguousarray(x[i : i + step])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([len(y)], pa.int64()), pa.array([y.tobytes()], pa.binary()),
                    pa.array([(y >> 32).sum(axis=0).tolist()], pa.list_(pa.int64())),
                    pa.array([(y & 0xFFFFFFFF).sum(axis=0).tolist()], pa.list_(pa.int64())),
                ],
                ["n", "x", "high", "low"],
            )


class FitList:
    """The distinct vectors, and products with their centred covariance."""

    def __init__(self, vectors: DataFrame, dim: int):
        self.dim = dim
        distinct = staged(vectors.mapInArrow(_whole_rows, "x array<bigint>").groupBy("x").agg(F.lit(1).alias("one")).select("x"))
        self.n = distinct.count()
        tasks = max(1, -(-self.n * dim // TASK))
        self.blocks = staged(distinct.repartition(tasks).mapInArrow(_blocks, "n long, x binary, high array<bigint>, low array<bigint>"))
        halves = (
            self.blocks.select(F.posexplode(F.arrays_zip("high", "low")).alias("pos", "s")).groupBy("pos")
            .agg(F.sum(F.col("s.high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("s.low").cast("decimal(38,0)")).alias("low"))
            .orderBy("pos").collect()
        )  # one row a dimension
        self.sums = [(int(r["high"]) << 32) + int(r["low"]) for r in halves]
        self.mean = np.array([s / self.n for s in self.sums])

    def summed(self, fn, size: int) -> np.ndarray:
        """The sum over all centred blocks z of ``fn(z)``, vectors of ``size`` numbers, in the order of the tasks."""
        mean, dim = self.mean, self.dim

        def run(batches):
            total = np.zeros(size)
            for b in batches:
                for raw in b.column("x").to_pylist():
                    total += fn(np.frombuffer(raw, dtype=np.int64).reshape(-1, dim) - mean)
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "total"]
            )

        def merge(batches):
            total = np.zeros(size)
            for b in batches:
                for raw in b.column("total").to_pylist():
                    total += np.frombuffer(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "total"]
            )

        sums = self.blocks.select("x").mapInArrow(run, "part long, total binary")
        if self.n * self.dim // TASK >= PARTS:
            dealt = sums.withColumn("to", F.pmod("part", F.lit(PARTS))).repartitionByRange(PARTS, "to")
            sums = dealt.sortWithinPartitions("part").mapInArrow(merge, "part long, total binary")
        rows = sorted(sums.collect(), key=lambda r: r["part"])
        return sum((np.frombuffer(r["total"]) for r in rows), np.zeros(size))

    def times(self, p: np.ndarray) -> np.ndarray:
        """Covariance times the columns of ``p``."""
        k = p.shape[1]
        return self.summed(lambda z: (z.T @ (z @ p)).reshape(-1), self.dim * k).reshape(self.dim, k) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda z: np.array([(z * z).sum()]), 1)[0]) / self.n

    def covariance_of(self, u: np.ndarray) -> np.ndarray:
        """Covariance of the projections of the centred vectors on the columns of ``u``."""
        k = u.shape[1]

        def moments(z):
            y = z @ u
            return np.concatenate([(y.T @ y).reshape(-1), y.sum(axis=0)])

        m = self.summed(moments, k * k + k) / self.n
        return m[: k * k].reshape(k, k) - np.outer(m[k * k :], m[k * k :])


def _against(basis: np.ndarray, t: np.ndarray) -> np.ndarray:
    return t - basis @ (basis.T @ t)


def orthonormal(basis: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Unit columns that span what ``t`` adds to the orthonormal ``basis``."""
    out = np.zeros((len(t), 0))
    for c in t.T:
        size = np.linalg.norm(c)
        if not size:
            continue
        c = c / size
        for _ in range(3):
            c = _against(out, _against(basis, c))
            left = np.linalg.norm(c)
            if left < 1e-10:
                break
            c = c / left
        else:
            out = np.column_stack([out, c])
    return out


class Corrections:
    """MINRES for the projected correction equations of several Ritz pairs, in step: one product serves all.

    Pair i: B t = -r with B = P (A - theta I) P and P projecting away from ``bases[i]`` (locked vectors and the pair's own)."""

    def __init__(self, theta: np.ndarray, bases: list[np.ndarray], r: np.ndarray):
        self.theta, self.bases = theta, bases
        v = np.column_stack([_against(b, -c) for b, c in zip(bases, r.T)])
        self.beta = np.linalg.norm(v, axis=0)
        self.v = v / np.where(self.beta > 0, self.beta, 1)
        self.v_old, self.d, self.d_old = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
        self.t = np.zeros_like(v)
        k = v.shape[1]
        self.c, self.s, self.c_old, self.s_old = np.ones(k), np.zeros(k), np.ones(k), np.zeros(k)
        self.rhs, self.beta_now = self.beta.copy(), np.zeros(k)

    def step(self, times) -> None:
        w = times(self.v)
        w = np.column_stack([_against(b, c - th * v) for b, c, th, v in zip(self.bases, w.T, self.theta, self.v.T)])
        w = w - self.v_old * self.beta_now
        alpha = (w * self.v).sum(axis=0)
        w = w - self.v * alpha
        beta = np.linalg.norm(w, axis=0)
        # the two last rotations act on the new column of the tridiagonal, then a third removes beta
        far, mid = self.s_old * self.beta_now, self.c_old * self.beta_now
        upper, diag = self.c * mid + self.s * alpha, -self.s * mid + self.c * alpha
        rho = np.hypot(diag, beta)
        safe = np.where(rho > 0, rho, 1)
        c, s = np.where(rho > 0, diag / safe, 1.0), beta / safe
        d = (self.v - self.d * upper - self.d_old * far) / safe
        self.t = self.t + np.where(rho > 0, c * self.rhs, 0.0) * d
        self.rhs = -s * self.rhs
        self.d_old, self.d = self.d, d
        self.c_old, self.s_old, self.c, self.s = self.c, self.s, c, s
        self.v_old, self.v, self.beta_now = self.v, w / np.where(beta > 0, beta, 1), beta


def jacobi_davidson(times, dim: int, k: int, tolerance: float = 2.0**-47) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the symmetric ``times`` (products with the columns of a matrix) and unit vectors.

    A pair is locked when its residual is ``tolerance`` times the largest eigenvalue at most, or when it no longer falls
    although it is near that (rounding of the products)."""
    k = min(k, dim)
    rng = np.random.default_rng(3)
    w = orthonormal(np.zeros((dim, 0)), rng.normal(size=(dim, min(dim, k + 2))))
    aw = times(w)
    locked, values = np.zeros((dim, 0)), []
    top, best, still = 0.0, np.inf, 0
    for _ in range(ROUNDS):
        h = w.T @ aw
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        u, au = w @ s, aw @ s
        top = max([top, *np.abs(theta[:1]).tolist()])
        r = _against(locked, au - u * theta)
        size = np.linalg.norm(r, axis=0)
        whole_space = locked.shape[1] + w.shape[1] >= dim
        still = still + 1 if size[0] > 0.5 * best else 0
        best = min(best, size[0])
        n = 0
        while n < len(theta) and locked.shape[1] + n < k and (
            size[n] <= tolerance * top or whole_space or (n == 0 and still >= 5 and size[0] <= 64 * tolerance * top)
        ):
            n += 1
        if n:
            locked = np.column_stack([locked, u[:, :n]])
            values += theta[:n].tolist()
            w, aw, theta, r, size = u[:, n:], au[:, n:], theta[n:], r[:, n:], size[n:]
            u, best, still = w, np.inf, 0
            if locked.shape[1] >= k or not w.shape[1]:
                break
        elif w.shape[1] > SPACE:
            w, aw, theta, r = u[:, : k + KEEP], au[:, : k + KEEP], theta[: k + KEEP], r[:, : k + KEEP]
            u = w
        else:
            w, aw = u, au
        want = min(k - locked.shape[1], u.shape[1])
        solve = Corrections(theta[:want], [np.column_stack([locked, u[:, [i]]]) for i in range(want)], r[:, :want])
        for _ in range(INNER):
            solve.step(times)
        more = orthonormal(np.column_stack([locked, w]), np.column_stack([solve.t, r[:, :want]]))
        if not more.shape[1]:
            more = orthonormal(np.column_stack([locked, w]), rng.normal(size=(dim, 1)))
        if more.shape[1]:
            w, aw = np.column_stack([w, more]), np.column_stack([aw, times(more)])
    else:
        raise ArithmeticError(f"{len(values)} of {k} eigenpairs found after {ROUNDS} rounds")
    # a last Rayleigh-Ritz over the locked vectors, with fresh products
    q, _ = np.linalg.qr(locked)
    a = times(q)
    h = q.T @ a
    theta, s = np.linalg.eigh((h + h.T) / 2)
    theta, q = theta[::-1], q @ s[:, ::-1]
    q = q * np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1.0, 1.0)
    return theta, q


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over dimensions of (n x - S)^2, null beyond a long."""
    rough = ((n * x.astype(np.float64) - np.array([float(s) for s in sums])) ** 2).sum(axis=1)
    fits = (rough < 2.0**62) & (np.abs(x).max(axis=1, initial=0) < 2.0**62 / max(1, n)) & (max(map(abs, sums), default=0) < 2**62)
    out: list[int | None] = [None] * len(x)
    at = np.flatnonzero(fits)
    if len(at):
        z = n * x[at] - np.array(sums, dtype=np.int64)
        for i, v in zip(at.tolist(), (z * z).sum(axis=1).tolist()):
            out[i] = v
    for i in np.flatnonzero(~fits & (rough < 2.0**64)).tolist():
        exact = sum((n * v - s) ** 2 for v, s in zip(x[i].tolist(), sums))
        out[i] = exact if exact < 2**63 else None
    return out


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding) without null, empty and non-finite vectors, of the most frequent length; that length, or 0."""
    e = F.col("embedding")
    fine = (F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.coalesce(fine, F.lit(False)))
    sizes = v.groupBy(F.size(e).alias("dim")).agg(F.count("*").alias("rows"))
    first = sizes.orderBy(F.desc("rows"), F.desc("dim")).first()
    return (v.where(F.size(e) == first["dim"]), first["dim"]) if first else (v, 0)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``vectors`` (vec_id, embedding; more columns are ignored): vec_id, n, deviation, and arrays
    by component: whitened, explained; identity_error."""
    v, dim = usable(vectors)
    schema = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    fit = FitList(v, dim) if dim else None
    trace = fit.trace() if fit else 0.0
    if not trace > 0:
        return vectors.sparkSession.createDataFrame([], schema)
    values, q = jacobi_davidson(fit.times, dim, components)
    some = values > 1e-13 * trace
    values, q = values[some], q[:, some]
    u = q / np.sqrt(values)
    error = float(np.abs(fit.covariance_of(u) - np.eye(len(values))).max())
    n, sums, mean, share = fit.n, fit.sums, fit.mean, (values / trace).tolist()
    handle = vectors.sparkSession.sparkContext.broadcast((sums, mean, u))  # dimensions x (components + 2) numbers

    def run(batches):
        sums, mean, u = handle.value
        for b in batches:
            x = whole(b.column("embedding"))
            k, rows = u.shape[1], len(x)
            off = pa.array((np.arange(rows + 1) * k).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id"), pa.array(np.full(rows, n)), pa.array(_deviations(x, n, sums), pa.int64()),
                    pa.ListArray.from_arrays(off, pa.array(((x - mean) @ u).reshape(-1))),
                    pa.ListArray.from_arrays(off, pa.array(np.tile(share, rows))),
                    pa.array(np.full(rows, error)),
                ],
                ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return v.mapInArrow(run, schema)
