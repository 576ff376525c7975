"""Whitening of embeddings by a Jacobi method on a Cholesky factor.

Vectors are put on a grid of whole numbers, so that counts, sums and
deviations are exact.  The fit list holds each distinct vector once.  Its
scatter is summed up from centred vectors, task by task and then across
tasks.  The scatter's pivoted Cholesky factor L (A = L L') is as large as the
dimension, not the table; one-sided Jacobi rotates pairs of its columns until
all are orthogonal.  L V = U S then, and A = U S^2 U': the squared column
norms are the eigenvalues and the normalised columns the components, to high
relative accuracy also for the small ones, which squaring would lose.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import common

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
MOST = float(1 << 50)     # entries from here on are treated as not finite
SPREAD = 64               # partial sums are added up in so many groups first


def grid(vector: Column) -> Column:
    """The vector as whole numbers floor(64 c) + 1000000; null if it is null
    or holds an entry that is null or not finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST))
    return F.when(fine, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long")))


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of an Arrow list array of one length."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


# ---- sums over the fit list ----------------------------------------------------
def sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(n, S): the rows and the exact sum of each dimension.  Halves of 32 bits
    are added in the tasks, so that no sum can overflow."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for b in batches:
            x = matrix(b.column(0))
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(np.full(dim, n)), pa.array(high), pa.array(low)],
                                         names=["i", "n", "high", "low"])
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    got = fit.select("x").mapInArrow(part, "i bigint, n bigint, high bigint, low bigint").groupBy("i").agg(
        total("n"), total("high"), total("low")).orderBy("i").collect()       # a row a dimension
    return int(got[0]["n"]) if got else 0, [(int(r["high"]) << 32) + int(r["low"]) for r in got]


class Centre:
    """The mean of the fit list as whole part and rest: x - S / n without
    cancellation."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], object)
        self.share = np.array([(s % n) / n for s in sums])

    def off(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.share

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)^2 of each row, exact; None beyond 64 bits."""
        y = x - self.whole
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * y - self.rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        return [d if d < 1 << 63 else None
                for d in (sum(v * v for v in self.n * row - self.rest) for row in y.astype(object))]


def added(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sums of the rows (i, v) by i: in groups across tasks, then over the
    groups; as many come to the driver as the matrix has rows."""
    def add(t: pa.Table) -> pa.Table:
        v = matrix(t["v"].combine_chunks()).sum(axis=0)
        return pa.table([t["i"][:1], t["g"][:1], pa.array([v], pa.list_(pa.float64()))], names=["i", "g", "v"])
    schema = "i bigint, g int, v array<double>"
    parts = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(SPREAD))).select("i", "g", "v")
    some = parts.groupBy("i", "g").applyInArrow(add, schema).withColumn("g", F.lit(0))
    return {r["i"]: np.array(r["v"]) for r in some.groupBy("i").applyInArrow(add, schema).collect()}


def products(fit: DataFrame, centre: Centre, by: np.ndarray | None = None) -> np.ndarray:
    """The sum of y y' over the fit list, y being centred vectors, or their
    projections on the columns of ``by``; a last row holds the sum of y."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            y = centre.off(matrix(b.column(0)))
            y = y if by is None else y @ by
            total = total + np.vstack([y.T @ y, y.sum(axis=0)])
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))],
                                             names=["i", "v"])
    got = added(fit.select("x").mapInArrow(part, "i bigint, v array<double>"))
    return np.stack([got[i] for i in range(len(got))])


# ---- the factor ------------------------------------------------------------------
def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with ``a`` = L L', as many columns as the numerical rank; each step
    takes the largest diagonal entry that is left."""
    a, d = a.copy(), len(a)
    out = np.zeros((d, d))
    left = a.diagonal().copy()
    least = d * np.finfo(float).eps * left.max(initial=0.0)
    done = np.zeros(d, bool)
    for k in range(d):
        p = int(np.argmax(np.where(done, -1.0, left)))
        if done[p] or left[p] <= least:
            return out[:, :k]
        root = math.sqrt(left[p])
        col = (a[:, p] - out[:, :k] @ out[p, :k]) / root
        col[done] = 0.0
        col[p] = root
        out[:, k] = col
        left -= col * col
        done[p] = True
    return out


def pairings(m: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs of 0 .. m - 1 in which each pair comes once."""
    ring = list(range(m + m % 2))
    rounds = []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        p, q = np.array(ring[:half]), np.array(ring[half:][::-1])
        real = (p < m) & (q < m)
        rounds.append((np.minimum(p, q)[real], np.maximum(p, q)[real]))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return rounds


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared norms, unit columns) of the rotated ``factor``, falling: pairs
    of columns are rotated, disjoint ones together, until each is orthogonal
    to rounding, or a sweep brings no pair closer to it."""
    x = factor.T.copy()                 # columns as rows
    near, last = len(factor) * np.finfo(float).eps, np.inf
    while len(x) > 1:
        worst = 0.0
        for p, q in pairings(len(x)):
            a, b, c = (x[p] ** 2).sum(1), (x[q] ** 2).sum(1), (x[p] * x[q]).sum(1)
            cosine = np.abs(c) / np.sqrt(np.maximum(a * b, np.finfo(float).tiny))
            worst = max(worst, float(cosine.max()))
            turn = cosine > near
            if not turn.any():
                continue
            p, q = p[turn], q[turn]
            tau = (b[turn] - a[turn]) / (2 * c[turn])
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.sqrt(1 + tau * tau))
            cos = 1 / np.sqrt(1 + t * t)
            sin = cos * t
            x[p], x[q] = cos[:, None] * x[p] - sin[:, None] * x[q], sin[:, None] * x[p] + cos[:, None] * x[q]
        if worst <= near or worst >= last:
            break
        last = worst
    norm = (x * x).sum(axis=1)
    order = np.argsort(-norm, kind="stable")
    norm, unit = norm[order], (x[order] / np.sqrt(norm[order])[:, None]).T
    if unit.size:                       # the largest entry of a component is positive
        unit = unit * np.sign(unit[np.abs(unit).argmax(axis=0), np.arange(unit.shape[1])])
    return norm, unit


class Whitening:
    """Fitted to a fit list: components (dim x k), eigenvalues, their share of
    the trace, and the error of the whitened covariance."""

    def __init__(self, centre: Centre | None, values: np.ndarray, vectors: np.ndarray, trace: float, k: int):
        self.centre, self.n = centre, centre.n if centre else 0
        self.values, self.vectors = values[:k], vectors[:, :k]
        self.explained = self.values / trace if len(self.values) else self.values
        self.by = self.vectors / np.sqrt(self.values) if len(self.values) else self.vectors
        self.error = 0.0

    def column(self, x: Column) -> Column:
        """deviation and whitened entries of each vector."""
        centre, by = self.centre, self.by

        @F.arrow_udf("struct<deviation:bigint,whitened:array<double>>")
        def udf(lists: pa.Array) -> pa.Array:
            m = matrix(lists)
            z = centre.off(m) @ by
            cut = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
            return pa.StructArray.from_arrays(
                [pa.array(centre.deviation(m), pa.int64()), pa.ListArray.from_arrays(cut, pa.array(z.ravel()))],
                names=["deviation", "whitened"])
        return udf(x)


def fit(vectors: DataFrame, dim: int, k: int = COMPONENTS) -> Whitening:
    """Fit to the stored ``vectors`` (x), each distinct one once: equal ones
    are combined before they are shuffled."""
    once = common.store(vectors.select("x").distinct(), "whiten-fit")
    n, s = sums(once, dim)
    if not n:
        return Whitening(None, np.zeros(0), np.zeros((dim, 0)), 0.0, k)
    centre = Centre(n, s)
    scatter = products(once, centre)[:-1] / n
    values, parts = jacobi(pivoted_cholesky(scatter))
    out = Whitening(centre, values, parts, float(np.trace(scatter)), k)
    if len(out.values):
        p = products(once, centre, out.by) / n
        out.error = float(np.abs(p[:-1] - np.outer(p[-1], p[-1]) - np.eye(len(p) - 1)).max())
    return out


def whiten(rows: DataFrame, vector: str = "embedding", k: int = COMPONENTS, carry: list[str] | None = None) -> DataFrame:
    """(__row, component, n, deviation, whitened, explained, identity_error)
    for every row of ``rows`` with a usable vector and every component up to
    ``k``, numbered from 1 by falling eigenvalue.

    Rows go whose vector is null, empty, or holds a null entry or one that is
    not finite (or from 2^50 on in size).  All vectors must have one length:
    that of most rows, the greater of equals; rows of another length go, too.
    Repeated rows count once for the fit and are all returned.  Where vectors
    span fewer than ``k`` dimensions there are as many components; of one
    distinct vector, or of an empty table, there are none and so no rows.
    deviation is null where it takes more than 64 bits.
    """
    common.prepare(rows.sparkSession)
    grown = rows.select(common.pack(rows.select(carry or rows.columns)), grid(F.col(f"`{vector}`")).alias("x"))
    grown = common.store(grown.where(F.size("x") > 0), "whiten-rows")
    usual = grown.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = usual["d"] if usual else 1
    grown = grown.where(F.size("x") == dim)
    w = fit(grown, dim, k)
    one = grown.select(common.ROW, w.column(F.col("x")).alias("c")) if len(w.values) else grown.limit(0).select(
        common.ROW, F.lit(None).cast("struct<deviation:bigint,whitened:array<double>>").alias("c"))
    each = one.select(common.ROW, "c.deviation", F.posexplode("c.whitened").alias("i", "whitened"))
    share = F.array(*map(F.lit, w.explained.tolist())) if len(w.values) else F.array(F.lit(0.0))
    return each.select(common.ROW, (F.col("i") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation",
                       "whitened", F.get(share, "i").alias("explained"), F.lit(w.error).alias("identity_error"))
