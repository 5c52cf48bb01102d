"""Whitening of embeddings by FEAST contour integration.

1. Spark sums the vectors, then their centred products (every task adds up its own rows, one row per
   pair of dimensions leaves it): the covariance, of the size of the model and not of the data.
2. ``feast`` cuts the upper spectrum into intervals with known numbers of eigenvalues (inertia of the shifted
   covariance), projects a random block onto each by a quadrature of complex shifted solves around the
   interval, extracts components by Rayleigh-Ritz and repeats until residuals are small and the
   number found equals the inertia count.
3. Spark projects every vector, and a pass over the projections measures how far their covariance is from the identity.

Vectors enter as integers x = floor(64 * entry) + 1,000,000. Defined results: vectors that are null or hold null or non-finite
entries take no part, nor do those of another length than most have (ties: the shorter), empty ones and those with
an entry of 2^46 or more (their x is no exact double); repeated rows count as often as they occur; components whose
eigenvalue is zero but for rounding (ZERO times the largest) don't exist, so one vector, or vectors all alike, give no row;
a deviation beyond the range of long is null; equal eigenvalues give any orthonormal basis; an empty table gives
an empty result; other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(2**46)
COMPONENTS = 32
ZERO = 1e-10
NODES = 8            # quadrature nodes on the half circle around an interval
PER_INTERVAL = 12    # eigenvalues an interval holds at most, unless they lie too close to be cut apart
ROUNDS = 20
RESIDUAL = 1e-13     # of the norm
ROWS = 4096          # rows multiplied at a time


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    v = F.col("v")
    d = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return d.where(v.isNotNull() & (F.size(v) > 0)
                   & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST)))


def _integers(batch, dim: int):
    """(ids, x) of a record batch, some thousand rows at a time."""
    for a in range(0, batch.num_rows, ROWS):
        part = batch.slice(a, ROWS)
        c = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        yield part.column("vec_id"), np.floor(SCALE * c).astype(np.int64) + SHIFT


@dataclass
class Moments:
    n: int
    near: np.ndarray    # integers next to the means
    rest: np.ndarray    # S - n * near, exact
    offset: np.ndarray  # mean - near

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(np.float64) - self.offset


def moments(vectors: DataFrame, dim: int) -> Moments:
    """Count and sums per dimension, exact at any size (sums travel in two halves)."""
    import pyarrow as pa

    def run(batches):
        n, halves = 0, np.zeros((2, dim), dtype=np.int64)
        for batch in batches:
            for _, x in _integers(batch, dim):
                n += len(x)
                halves += (x >> 26).sum(axis=0), (x & (2**26 - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim)), pa.array([n] * dim), *map(pa.array, halves)],
                                             names=["i", "n", "high", "low"])

    got = vectors.mapInArrow(run, "i long, n long, high long, low long").groupBy("i") \
        .agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]).orderBy("i").collect()
    n = int(got[0]["n"])
    sums = [(int(r["high"]) << 26) + int(r["low"]) for r in got]
    near = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, near)]
    return Moments(n, np.array(near, dtype=np.int64), np.array(rest, dtype=np.int64),
                   np.array([float(Fraction(r, n)) for r in rest]))


def _mean_products(vectors: DataFrame, dim: int, width: int, rows_of) -> np.ndarray:
    """Mean of the outer products of what ``rows_of`` makes of the integers; upper triangles leave the tasks."""
    import pyarrow as pa

    i, j = np.triu_indices(width)

    def run(batches):
        n, total = 0, np.zeros((width, width))
        for batch in batches:
            for _, x in _integers(batch, dim):
                y = rows_of(x)
                n += len(y)
                total += y.T @ y
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "s"])

    out = np.zeros((width, width))
    for r in vectors.mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


# ---------------------------------------------------------------- eigenvalues
def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a similar tridiagonal matrix, by Householder reflections."""
    a = a.copy()
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        alpha = -np.copysign(np.linalg.norm(v), v[0])
        if alpha == 0:
            continue
        v[0] -= alpha
        v /= np.linalg.norm(v)
        a[k + 1:, :] -= 2 * np.outer(v, v @ a[k + 1:, :])
        a[:, k + 1:] -= 2 * np.outer(a[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def inertia(diag: np.ndarray, off: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: positive pivots of the shifted tridiagonal matrix."""
    tiny = np.finfo(float).tiny ** 0.5 * (1 + abs(shift))
    above, pivot, before = 0, 1.0, 0.0
    for d, e in zip(diag.tolist(), [*off.tolist(), 0.0]):
        pivot = d - shift - before * before / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        above += pivot > 0
        before = e
    return above


def intervals(v: np.ndarray, k: int, norm: float) -> list[tuple[float, float, int]]:
    """Intervals (low, high, count) from the top until they hold ``k`` eigenvalues; ends keep off eigenvalues."""
    diag, off = tridiagonal(v)
    gap = 1e-9 * norm

    def cut(low, high):
        for share in (0.5, 0.44, 0.56, 0.38, 0.62, 0.31, 0.69):
            at = low + share * (high - low)
            if inertia(diag, off, at - gap) == inertia(diag, off, at + gap):
                return at
        return None

    done, todo, have = [], [(-0.01 * norm, 1.01 * norm)], 0
    while todo and have < k:
        low, high = todo.pop()
        count = inertia(diag, off, low) - inertia(diag, off, high)
        if not count:
            continue
        at = cut(low, high) if count > PER_INTERVAL and high - low > 8 * gap else None
        if at is None:
            done.append((low, high, count))
            have += count
        else:
            todo += [(low, at), (at, high)]  # the upper one is looked at first
    return done


def feast_interval(v: np.ndarray, low: float, high: float, count: int, norm: float) -> np.ndarray:
    """Orthonormal components whose eigenvalues lie between ``low`` and ``high``: ``count`` of them."""
    d = len(v)
    middle, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    around = radius * np.exp(0.5j * np.pi * (1 - nodes))
    width = min(d, count + max(4, count // 2))
    while True:
        block = np.random.default_rng(width).standard_normal((d, width))
        for _ in range(ROUNDS):
            moved = np.zeros_like(block)
            for z, w in zip(around, weights):
                moved += 0.5 * w * (z * np.linalg.solve((middle + z) * np.eye(d) - v, block)).real
            basis = np.linalg.qr(moved)[0]
            ritz, inner = np.linalg.eigh(basis.T @ v @ basis)
            block = basis @ inner
            mine = (ritz > low) & (ritz <= high)
            left = np.linalg.norm(v @ block[:, mine] - block[:, mine] * ritz[mine], axis=0)
            if mine.sum() == count and (left <= RESIDUAL * d * norm).all():
                return block[:, mine]
        if width == d:
            raise ArithmeticError(f"{mine.sum()} of {count} components found between {low} and {high}")
        width = min(d, 2 * width)


def feast(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns."""
    norm = float(np.abs(v).sum(axis=0).max())
    if norm == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    found = [feast_interval(v, low, high, count, norm) for low, high, count in intervals(v, min(k, len(v)), norm)]
    basis = np.linalg.qr(np.hstack(found))[0]
    ritz, inner = np.linalg.eigh(basis.T @ v @ basis)  # one basis over all intervals
    order = np.argsort(-ritz, kind="stable")[:k]
    return ritz[order], basis @ inner[:, order]


# ---------------------------------------------------------------- output
def deviations(x: np.ndarray, m: Moments) -> list:
    """Per row the sum of (n * x - S)^2, exact; None beyond the range of long."""
    t = m.n * (x - m.near) - m.rest
    with np.errstate(over="ignore"):
        exact = (t * t).sum(axis=1)   # wraps around, so right whenever the true sum fits
    y = (x - m.near).astype(np.float64) * m.n - m.rest
    about = (y * y).sum(axis=1)
    out = exact.tolist()
    for i in np.flatnonzero(about > 2.0**62).tolist():
        true = sum((m.n * (int(a) - int(b)) - int(r)) ** 2 for a, b, r in zip(x[i], m.near, m.rest))
        out[i] = true if true < 2**63 else None
    return out


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per vector and component, components numbered from 1."""
    import pyarrow as pa

    vectors = usable(rows, id_col, vector_col)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, {OUT}"
    lengths = vectors.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema)
    dim = lengths["dim"]
    vectors = vectors.where(F.size("v") == dim)
    m = moments(vectors, dim)
    covariance = _mean_products(vectors, dim, dim, m.centred) / m.n
    values, axes = feast(covariance, components)
    real = values > ZERO * values.max(initial=0)
    values, axes = values[real], axes[:, real]
    k = len(values)
    if k == 0:
        return rows.sparkSession.createDataFrame([], schema)
    explained = values / np.trace(covariance)
    project = axes / np.sqrt(values)

    def with_one(x):
        return np.hstack([m.centred(x) @ project, np.ones((len(x), 1))])

    products = _mean_products(vectors, dim, k + 1, with_one) / m.n
    mean = products[:k, k]
    error = float(np.abs(products[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches):
        for batch in batches:
            for ids, x in _integers(batch, dim):
                w, rows_in = m.centred(x) @ project, len(x)
                each = np.repeat(np.arange(rows_in), k)
                deviation = pa.array(deviations(x, m), pa.int64()).take(pa.array(each))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_in)),
                     pa.array(np.full(rows_in * k, m.n)), deviation, pa.array(w.reshape(-1)),
                     pa.array(np.tile(explained, rows_in)), pa.array(np.full(rows_in * k, error))],
                    names=[c.split()[0] for c in schema.split(", ")])

    return vectors.mapInArrow(run, schema)


def op11(rows: DataFrame) -> DataFrame:
    return whiten(rows)
