"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

The sums that the factorisation needs are made by Spark: distinct integer vectors, their number and sums, and one
dimensions x dimensions scatter a task, added up by a grouped sum. Only those sums, whose size follows the dimensions and
not the rows, reach the driver, where the small factorisation runs; the projection is one pass over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved, slices

SCALE, SHIFT = 64, 1_000_000
#: An entry beyond it has no exact place on the integer grid of doubles.
LARGEST = float(1 << 52)
#: Pivots below this share of the largest one are rounding of a dependent dimension.
RANK_SHARE = 1e-12
ROWS = 4096


def grid(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x): entries as whole numbers floor(64 c) + 1000000, of rows whose vector is finite and fits."""
    v = F.col(vector).cast("array<double>")
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / SCALE)
    own = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce((F.size("v") > 0) & F.forall("v", fits), F.lit(False)))
    return own.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _add_up(fit: DataFrame, block) -> np.ndarray:
    """The symmetric matrix that is the sum of ``block`` over the rows of ``fit`` (x): one a task, then added up by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in slices(batches, ROWS):
            if b.num_rows:
                own = block(_matrix(b.column(0)))
                total = own if total is None else total + own
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.float64())], names=["i", "j", "s"])

    parts = fit.select("x").mapInArrow(run, "i int, j int, s double")
    rows = parts.groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    if not rows.num_rows:
        return np.zeros((0, 0))
    i, j, s = (rows[c].to_numpy() for c in ("i", "j", "s"))
    out = np.zeros((i.max() + 1,) * 2)
    out[i, j] = out[j, i] = s
    return out


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with v[order][:, order] = L L', the largest remaining diagonal entry first; as many columns as the rank."""
    a, order, d = v.copy(), np.arange(len(v)), len(v)
    low = np.zeros((d, d))
    first = a.diagonal().max(initial=0.0)
    for k in range(d):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= first * RANK_SHARE or a[p, p] <= 0:
            return low[:, :k], order
        for m in (a, low):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        low[k:, k] = a[k:, k] / np.sqrt(a[k, k])
        a[k + 1 :, k + 1 :] -= np.outer(low[k + 1 :, k], low[k + 1 :, k])
    return low, order


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns in rounds of disjoint pairs: one stays, the others move round the table."""
    seats = list(range(n + n % 2))
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(seats[:half], reversed(seats[half:])) if max(a, b) < n]
        yield np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
        seats = [seats[0], seats[-1], *seats[1:-1]]


def one_sided_jacobi(low: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """Rotates columns until they are orthogonal to each other; disjoint pairs are rotated together."""
    g = low.copy()
    rounds = [r for r in _rounds(g.shape[1]) if len(r[0])]
    for _ in range(sweeps):
        worst = 0.0
        for i, j in rounds:
            p, q = g[:, i], g[:, j]
            a, b, c = (p * p).sum(0), (q * q).sum(0), (p * q).sum(0)
            off = np.abs(c) / np.sqrt(a * b)
            worst = max(worst, off.max())
            turn = off > 1e-17
            z = (b - a) / (2 * np.where(turn, c, 1.0))
            t = np.where(turn, np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z)), 0.0)
            cos = 1 / np.hypot(1.0, t)
            g[:, i], g[:, j] = cos * (p - t * q), cos * (q + t * p)
        if worst < 1e-15:
            break
    return g


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a covariance, largest first, as many as its rank. The entry of a
    vector that is largest in size is positive, so that the sign is the same in every run."""
    low, order = pivoted_cholesky(v)
    if not low.shape[1]:
        return np.zeros(0), np.zeros((len(v), 0))
    g = one_sided_jacobi(low)
    norms = np.sqrt((g * g).sum(0))
    by = np.argsort(-norms, kind="stable")
    u = np.empty_like(g)
    u[order] = (g / norms)[:, by]
    peak = np.abs(u).argmax(0)
    return norms[by] ** 2, u * np.where(u[peak, np.arange(u.shape[1])] < 0, -1.0, 1.0)


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: as longs where they fit, else as Python's integers."""
    fits = max(max(map(abs, sums)), n * max(abs(int(x.max())), abs(int(x.min())))) < 1 << 61
    kind = np.int64 if fits else object
    return x.astype(kind) * n - np.array(sums, kind)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_scaled(x, n, sums) / n).astype(float)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact; null where a sum doesn't fit a long."""
    d = _scaled(x, n, sums)
    if d.dtype != object and max(abs(int(d.max())), abs(int(d.min()))) ** 2 * d.shape[1] < 1 << 63:
        return (d * d).sum(1).tolist()
    d = d.astype(object)
    return [int(s) if s < 1 << 63 else None for s in (d * d).sum(1)]


def whiten(vectors: DataFrame, top: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): up to ``top`` rows a row of ``vectors``
    (vec_id, embedding; other columns are ignored), one a component.

    Rows whose vector is null, empty, or has a null, non-finite or larger entry than 2**46 are left out. Repeated rows and null
    vec_ids stay as they are; equal vectors count once in the fit. There are as many components as the covariance's rank,
    so none for one distinct vector. Vectors of different lengths are whitened apart. An empty table gives no row.
    ``deviation`` is null where it doesn't fit a long.
    """
    spark = vectors.sparkSession
    own = grid(vectors)
    fit = saved(own.select("x").distinct(), "whitening-fit")
    out = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for size in sorted(r[0] for r in fit.select(F.size("x").alias("size")).distinct().collect()):
        out = out.union(_whiten_one(own.where(F.size("x") == size), fit.where(F.size("x") == size), size, top))
    return out


def _whiten_one(own: DataFrame, fit: DataFrame, size: int, top: int) -> DataFrame:
    total = fit.agg(F.count("*"), *(F.sum(F.col("x")[k].cast("decimal(38,0)")) for k in range(size))).first()
    n, sums = total[0], [int(s) for s in total[1:]]

    def scatter(x: np.ndarray) -> np.ndarray:
        c = _centred(x, n, sums)
        return c.T @ c

    v = _add_up(fit, scatter) / n
    e, u = components(v)
    k = min(top, len(e))
    basis, shares = u[:, :k] / np.sqrt(e[:k]), e[:k] / max(v.trace(), np.finfo(float).tiny)

    def whitened_scatter(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, sums) @ basis
        return w.T @ w

    error = float(np.abs(_add_up(fit, whitened_scatter) / n - np.eye(k)).max()) if k else 0.0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            if not b.num_rows or not k:
                continue
            x = _matrix(b.column(1))
            far, m = pa.array(_deviations(x, n, sums), pa.int64()), b.num_rows
            each = pa.array(np.repeat(np.arange(m), k))
            w = _centred(x, n, sums) @ basis
            yield pa.record_batch(
                [b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), far.take(each), pa.array(w.ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return own.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
