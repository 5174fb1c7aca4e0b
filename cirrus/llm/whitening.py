"""Embedding whitening by contour integration (operator 13).

Vectors become whole numbers; every distinct one is in the fit list once. The list's
sums are exact and its covariance comes from rows centred on them, as partial products
of Arrow batches that are added row by row. Its leading eigenpairs are found with FEAST:

1. Inertia counts (negative pivots of an LDL^T factorisation of V - s I, by Sylvester's
   law) say how many eigenvalues lie above s. Bisection on them finds intervals that
   together hold the wanted eigenvalues and a few each.
2. For each interval, a Gauss-Legendre rule on the half circle over it sums complex
   shifted solves (z I - V)^-1 Y: a filter that projects the block Y onto the interval's
   eigenvectors. Rayleigh-Ritz on the projected block gives eigenpairs, and the step is
   repeated from them until the residuals are those of rounding.
3. The number of pairs found in an interval must equal its inertia count; a block that
   misses some is widened and filtered again.

Rows are then projected and scaled, and the covariance of what comes out is measured on
the fit list. All passes over rows run in Spark tasks; the driver holds one d x d matrix
for each length of vector (MAX_WIDTH bounds d).

Rows whose vector is null or holds null or non-finite entries are dropped, empty vectors
too. Vectors of one length are one table: each length has a fit of its own. Repeated
vectors count once in the fit and are given each. Components whose eigenvalue is rounding
noise (below RANK times the largest), and so all components of a single distinct vector,
are left out. An entry or a squared deviation that 64 bits do not hold raises. Only the
id and the vector are read, so clashing columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base
from .topk import whole

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Widest vector whose covariance the driver holds.
MAX_WIDTH = 8192
#: Quadrature points on the half circle, eigenvalues wanted in one interval, filter steps at most.
POINTS, INTERVAL, STEPS = 8, 6, 40
RANK = 1e-12
#: Distance, relative to the norm, that bisection points keep from eigenvalues.
CLEAR = 1e-13
#: Tasks that add up the partial matrices.
ADDERS = 32


def inertia(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of the symmetric `v` below `shift`: negative pivots of LDL^T of
    v - shift I, with Bunch-Kaufman pivots of one and two rows."""
    a = v - shift * np.eye(len(v))
    limit, tiny = (1 + 17**0.5) / 8, np.finfo(float).tiny
    below = k = 0
    n = len(a)
    while k < n:
        if k == n - 1:
            below += int(a[k, k] < 0)
            break
        col = np.abs(a[k + 1 :, k])
        r = k + 1 + int(col.argmax())
        most, own, two = col[r - k - 1], abs(a[k, k]), False
        if max(most, own) <= tiny:
            k += 1
            continue
        if own < limit * most:
            row = np.abs(a[r, k:])
            row[r - k] = 0
            sigma = row.max()
            if own * sigma < limit * most * most:
                if abs(a[r, r]) >= limit * sigma:
                    a[[k, r]] = a[[r, k]]
                    a[:, [k, r]] = a[:, [r, k]]
                else:
                    two = True
                    a[[k + 1, r]] = a[[r, k + 1]]
                    a[:, [k + 1, r]] = a[:, [r, k + 1]]
        if two:  # a pivot of two rows has a negative determinant: one value on each side
            below += 1
            pivot, rest = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(pivot, rest.T)
            k += 2
        else:
            below += int(a[k, k] < 0)
            c = a[k + 1 :, k]
            a[k + 1 :, k + 1 :] -= np.outer(c, c / a[k, k])
            k += 1
    return below


def _intervals(v: np.ndarray, k: int, low: float, high: float) -> list[tuple[float, float, int]]:
    """Intervals (a, b, count) from the top down that hold the k largest eigenvalues between
    `low` and `high`, and those that no bisection tells from the k-th."""
    scale = max(abs(low), abs(high), np.finfo(float).tiny)
    n_low, n_high = inertia(v, low), inertia(v, high)
    done, todo = [], [(low, high, n_low, n_high)]
    need = k
    while todo and need > 0:
        a, b, below_a, below_b = todo.pop()  # the topmost interval
        count = below_b - below_a
        if count == 0:
            continue
        if (count <= INTERVAL and count <= need) or b - a <= 64 * CLEAR * scale:
            done.append((a, b, count))
            need -= count
            continue
        # a point that no eigenvalue lies next to: rounding must not move one across it
        for part in (0.5, 0.46, 0.55, 0.41, 0.6, 0.37, 0.64):
            mid = a + part * (b - a)
            below = inertia(v, mid - CLEAR * scale)
            if below == inertia(v, mid + CLEAR * scale):
                break
        todo += [(a, mid, below_a, below), (mid, b, below, below_b)]
    return done


def _filtered(v: np.ndarray, y: np.ndarray, a: float, b: float) -> np.ndarray:
    """The block `y` through the contour around [a, b]: quadrature of (z I - V)^-1 y."""
    at, weight = np.polynomial.legendre.leggauss(POINTS)
    centre, radius = (a + b) / 2, (b - a) / 2
    out = np.zeros_like(y)
    eye = np.eye(len(v))
    for x, w in zip(at, weight):
        turn = np.exp(1j * np.pi / 2 * (1 - x))  # the upper half circle; the lower one is its conjugate
        out += w / 2 * np.real(radius * turn * np.linalg.solve((centre + radius * turn) * eye - v, y))
    return out


def _pairs(v: np.ndarray, a: float, b: float, count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenpairs in the interval (a, b) of `v`, whose norm is about 1."""
    n, norm = len(v), float(np.abs(v).sum(1).max())
    # a contour a little wider than the interval: eigenvalues near its ends stay well inside
    pad = max((b - a) * 0.05, 1e-12)
    size = min(n, max(count + 4, 3 * count // 2 + 2))
    y = rng.normal(size=(n, size))
    best = None
    for step in range(STEPS):
        q, _ = np.linalg.qr(_filtered(v, y, a - pad, b + pad))
        small = q.T @ v @ q
        value, turn = np.linalg.eigh((small + small.T) / 2)
        vector = q @ turn
        error = np.linalg.norm(v @ vector - vector * value, axis=0)
        inside = ((value >= a - CLEAR) & (value <= b + CLEAR)).nonzero()[0]
        if len(inside) > count:  # Ritz values at the very ends, or not yet settled: those of least error
            inside = np.sort(inside[np.argsort(error[inside])[:count]])
        if len(inside) == count:
            worst = float(error[inside].max())
            if best is None or worst < best[0]:
                best = (worst, value[inside], vector[:, inside])
            elif worst <= 1e-10 * norm:
                break  # no better than before, and at the level of rounding
            if worst <= 1e-16 * norm:
                break
        if step % 4 == 3 and (best is None or best[0] > 1e-10 * norm):
            size = min(n, 2 * size)  # the contour holds more than the block does
        y = np.concatenate([vector, rng.normal(size=(n, size - vector.shape[1]))], 1) if size > vector.shape[1] else vector
    if best is None or best[0] > 1e-10 * norm:
        raise RuntimeError(f"{count} eigenvalues between {a} and {b} were counted, but not found")
    return best[1], best[2]


def leading(v: np.ndarray, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the symmetric positive semidefinite `v`, falling, and
    their unit eigenvectors as columns; fewer where the rank is lower."""
    n = len(v)
    norm = float(np.abs(v).sum(1).max()) if n else 0.0
    if norm == 0.0 or not np.isfinite(norm):
        if norm == 0.0:
            return np.zeros(0), np.zeros((n, 0))
        raise ValueError("the covariance is not finite")
    rng = np.random.default_rng(seed)
    unit = v / norm
    k = min(k, n)
    found = [_pairs(unit, a, b, count, rng) for a, b, count in _intervals(unit, k, -1e-3, 1.0 + 1e-9)]
    # one Rayleigh-Ritz over all intervals makes the vectors orthogonal to each other as well
    q, _ = np.linalg.qr(np.concatenate([x for _, x in found], 1))
    small = q.T @ unit @ q
    value, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-value)[:k]
    value, vector = value[order], (q @ turn)[:, order]
    good = value > RANK * value[0]
    vector = vector[:, good]
    return value[good] * norm, vector / np.linalg.norm(vector, axis=0)


@dataclass
class Fit:
    n: int
    sums: np.ndarray  # whole numbers, by dimension
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """S / n as a whole number and the remainder, so that x - S / n loses no digits."""
        near = np.array([int(s) // self.n for s in self.sums], np.int64)
        return near, np.array([(int(s) - int(c) * self.n) / self.n for s, c in zip(self.sums, near)])

    def whitened(self, x: np.ndarray, centre: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return ((x - centre[0]) - centre[1]) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)^2, exact; beyond 64 bits it raises."""
        near = np.array([int(s) // self.n for s in self.sums], np.int64)
        rest = np.array([int(s) - int(c) * self.n for s, c in zip(self.sums, near)], np.int64)
        about = ((self.n * (x - near).astype(np.float64) - rest) ** 2).sum(1)
        if (about > 9.2e18).any():
            raise OverflowError("a squared deviation is beyond 64 bits")
        d = self.n * (x - near) - rest  # every square is below 2**63, as their sum is
        return (d * d).sum(1)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _by_width(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the vectors of a batch, one for each length."""
    column = batch.column(batch.schema.get_field_index(name))
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(size).tolist():
        rows = (size == d).nonzero()[0]
        yield d, rows, _matrix(column.take(pa.array(rows)), d)


def _added(rows: DataFrame, make, shapes: str = "_d int, _r int, _v binary") -> dict[int, np.ndarray]:
    """Sum over all batches of the matrix that `make(length, matrix)` returns, for each length.
    Every task adds up its own; matrix rows are dealt to ADDERS tasks and added in task order."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _by_width(batch, "_x"):
                part = make(d, x)
                total[d] = total[d] + part if d in total else part
        for d, m in total.items():
            for a in range(0, len(m), 256):
                block = m[a : a + 256]
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(block), pa.int32()), pa.array(range(a, a + len(block)), pa.int32()), pa.array([r.tobytes() for r in block], pa.binary())], names=["_d", "_r", "_v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for d, r, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (d, r) != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["_d", "_r", "_v"])
                    now, total = (d, r), np.zeros(len(v) // 8)
                total = total + np.frombuffer(v)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["_d", "_r", "_v"])

    parts = rows.mapInArrow(own, shapes).withColumn("_t", F.spark_partition_id())
    added = parts.repartition(ADDERS, "_d", "_r").sortWithinPartitions("_d", "_r", "_t").drop("_t").mapInArrow(add, shapes)
    out: dict[int, dict[int, np.ndarray]] = {}
    for row in added.toArrow().to_pylist():
        out.setdefault(row["_d"], {})[row["_r"]] = np.frombuffer(row["_v"])
    return {d: np.stack([m[r] for r in range(len(m))]) for d, m in out.items()}


def fit(rows: DataFrame, vector: str = "_x", components: int = COMPONENTS) -> tuple[dict[int, Fit], float]:
    """Fits by length of the whole-number vectors of `rows`, and the largest absolute entry of
    the whitened fit lists' covariances minus the identity."""
    spark = base.ready(rows.sparkSession)
    distinct = base.hold(rows.select(base.quoted(vector).alias("_x")).distinct(), "fit")
    sums = distinct.select(F.size("_x").alias("_d"), F.posexplode("_x").alias("_r", "_e")).groupBy("_d", "_r").agg(F.count("*").alias("n"), F.sum("_e").alias("s")).collect()
    fits = {}
    for d in sorted({r["_d"] for r in sums}):
        if d > MAX_WIDTH:
            raise ValueError(f"vectors of {d} components: the covariance is held up to {MAX_WIDTH}")
        own = {r["_r"]: r for r in sums if r["_d"] == d}
        fits[d] = Fit(own[0]["n"], np.array([own[r]["s"] for r in range(d)], object), np.zeros(0), np.zeros((d, 0)), 0.0)
    shared = spark.sparkContext.broadcast({d: (f, f.centre()) for d, f in fits.items()})

    def products(d: int, x: np.ndarray) -> np.ndarray:
        near, rest = shared.value[d][1]
        y = (x - near) - rest
        return y.T @ y

    for d, m in _added(distinct, products).items():
        f = fits[d]
        v = m / f.n
        f.trace = float(np.trace(v))
        f.values, f.vectors = leading((v + v.T) / 2, components)
    done = spark.sparkContext.broadcast({d: (f, f.centre()) for d, f in fits.items()})

    def moments(d: int, x: np.ndarray) -> np.ndarray:
        f, centre = done.value[d]
        w = f.whitened(x, centre)
        return np.concatenate([w.T @ w, w.sum(0, keepdims=True)])

    error = 0.0
    for d, m in _added(distinct, moments).items():
        n, k = fits[d].n, len(fits[d].values)
        if k:
            mean = m[k] / n
            error = max(error, float(np.abs(m[:k] / n - np.outer(mean, mean) - np.eye(k)).max()))
    base.release(distinct)
    return fits, error


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: Column | str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each row of `df` that is not dropped and component: vec_id, component, n,
    deviation, whitened, explained, identity_error. `vector` is an array of numbers."""
    spark = base.ready(df.sparkSession)
    v = base.quoted(vector) if isinstance(vector, str) else vector
    x = F.transform(whole(v, SCALE), lambda c: c + SHIFT)
    rows = base.hold(df.select(base.quoted(vec_id).alias("vec_id"), x.alias("_x")).where("_x is not null and size(_x) > 0"), "whole")
    fits, error = fit(rows, "_x", components)
    shared = spark.sparkContext.broadcast({d: (f, f.centre()) for d, f in fits.items()})
    schema = T.StructType([rows.schema["vec_id"], *(T.StructField(n, t) for n, t in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_width(batch, "_x"):
                f, centre = shared.value[d]
                k = len(f.values)
                if not k:
                    continue
                w, m = f.whitened(x, centre), len(at)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n, np.int64)),
                    pa.array(np.repeat(f.deviation(x), k)), pa.array(w.reshape(-1)), pa.array(np.tile(f.values / f.trace, m)), pa.array(np.full(m * k, error))], names=schema.names)

    return rows.mapInArrow(project, schema)
