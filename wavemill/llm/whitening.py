"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

The scatter is added up in whole numbers: vectors are moved by the whole number
nearest to the mean before they are multiplied, and what the mean lacks to a whole
number is taken off exactly, so that nothing cancels. Its pivoted Cholesky
factor F (F F^T is the scatter, the largest remaining variance first, stopping at
the rank) is of the size of the dimensions, and Jacobi rotations of pairs of its
columns make these orthogonal without ever forming a product: a column's squared norm is then
an eigenvalue, the column over its norm the component.

The fit list holds each distinct vector once, however often rows repeat it. Tables
are read in three passes (sums, scatter, projection), each adding up where the rows
lie; only numbers in the square of the dimension reach the driver.

Defined cases: vectors that are null or hold null or non-finite components take
no part; shorter vectors are padded with zeros; ids may be null or repeat, each row
gets its own results; components without variance (beyond the rank of the scatter) do not exist,
so constant tables and single vectors give no rows, as does an empty table; scaled
components saturate at 64 bits; a deviation that does not fit a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, kept
from .vectors import added, floored, moved, products, stacked, wide


@dataclass
class Whitening:
    """What was learned: ``n`` distinct vectors, their sums, components as columns, their eigenvalues (falling), and the trace."""

    dims: int
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: in 64 bits where these hold it, else in integers without bounds."""
        most = self.n * float(np.abs(x.astype(float)).max(initial=0)) + max((abs(float(s)) for s in self.sums), default=0.0)
        if most < 2.0**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * wide(x) - np.array(self.sums, object)

    def project(self, centred: np.ndarray, k: int) -> np.ndarray:
        """Rows of whitened components from rows of n * x - S."""
        return (centred.astype(float) / self.n) @ self.components[:, :k] / np.sqrt(self.eigenvalues[:k])


def cholesky(scatter: np.ndarray) -> np.ndarray:
    """F with F F^T = scatter, a column for each pivot; pivots by falling remaining variance, ending where rounding is all that remains."""
    d = len(scatter)
    rest = np.diag(scatter).copy()
    floor = d * np.finfo(float).eps * rest.max(initial=0.0)
    out = np.zeros((d, d))
    done: list[int] = []
    for k in range(d):
        rest[done] = -1.0
        p = int(rest.argmax())
        if rest[p] <= floor:
            return out[:, :k]
        column = (scatter[:, p] - out[:, :k] @ out[p, :k]) / np.sqrt(rest[p])
        column[done] = 0.0
        out[:, k] = column
        rest -= column**2
        done.append(p)
    return out


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(components, eigenvalues) of factor factor^T, falling: columns are rotated in pairs, half of them at a time, until all are orthogonal."""
    f = factor.copy()
    r = f.shape[1]
    seats = np.arange(r + r % 2)  # a tournament: every pair of columns meets once a sweep
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(len(seats) - 1, 0)):
            p, q = seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            a, b = f[:, p], f[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            off = np.abs(ab) / np.sqrt(np.maximum(aa * bb, np.finfo(float).tiny))
            worst = max(worst, off.max(initial=0.0))
            turn = off > np.finfo(float).eps
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                zeta = (bb - aa) / (2 * ab)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta**2))
            t = np.where(turn & np.isfinite(t), t, 0.0)
            c = 1 / np.sqrt(1 + t**2)
            f[:, p], f[:, q] = c * a - c * t * b, c * t * a + c * b
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= 4 * np.finfo(float).eps * np.sqrt(max(len(f), 1)):
            break
    squared = (f * f).sum(0)
    order = np.argsort(-squared, kind="stable")
    order = order[squared[order] > 0]
    return f[:, order] / np.sqrt(squared[order]), squared[order]


def fit(vectors: DataFrame, vector_col: str = "embedding", scale: float = 256.0, k: int = 4) -> Whitening:
    """Learn from each distinct vector of floor(scale * component) once; ``identity_error`` is measured over the first ``k`` components."""
    distinct = kept(vectors.select(floored(vector_col, scale).alias("x")).where("x is not null").distinct())
    dims, n = distinct.agg(F.max(F.size("x")), F.count(F.lit(1))).first()
    if dims:  # vectors that only differ in the zeros they end in are equal
        if distinct.where(F.size("x") < dims).limit(1).count():
            padded = kept(distinct.select(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))).alias("x")).distinct())
            discard(distinct)
            distinct, n = padded, padded.count()
    if not n or not dims:
        discard(distinct)
        return Whitening(0, n or 0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    found = added(distinct, "x", dims, lambda x: products(np.ones((len(x), 1), np.int64), x))
    sums = [found[0, j] for j in range(dims)]
    near = [(2 * s + n) // (2 * n) for s in sums]
    found = added(distinct, "x", dims, lambda x: products(z := moved(x, near), z))
    lacks = [s - n * m for s, m in zip(sums, near, strict=True)]
    scatter = np.array([[(n * found[i, j] - lacks[i] * lacks[j]) / (n * n) for j in range(dims)] for i in range(dims)])
    components, values = jacobi(cholesky(scatter))
    out = Whitening(dims, n, sums, components, values, float(np.trace(scatter)))
    out.identity_error = _identity_error(distinct, out, min(k, len(values)))
    discard(distinct)
    return out


def _identity_error(distinct: DataFrame, model: Whitening, k: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list, less the identity; whitened vectors are centred already."""
    if not k:
        return None
    dims = model.dims

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for b in batches:
            w = model.project(model.centred(stacked(b["x"], dims)), k)
            total += w.T @ w
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "value": total.ravel()})

    parts = distinct.mapInPandas(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    return max(abs(r["value"] / model.n - (r["i"] == r["j"])) for r in parts.collect())


def whiten(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, k: int = 4) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and each of the first ``k`` components."""
    k = min(k, len(model.eigenvalues))
    dims = model.dims
    share = (model.eigenvalues[:k] / model.trace).tolist() if k else []
    least, most = -(2**63), 2**63 - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            centred = model.centred(stacked(b["x"], dims))
            if centred.dtype == object or float(np.abs(centred.astype(float)).max(initial=0)) ** 2 * dims >= 2.0**62:
                deviation = [v if least <= v <= most else None for v in (wide(centred) ** 2).sum(1)]
            else:
                deviation = (centred**2).sum(1).tolist()
            w = model.project(centred, k)
            yield pd.DataFrame({
                "vec_id": b["id"].repeat(k).to_numpy(),
                "component": np.tile(np.arange(1, k + 1), len(b)),
                "n": model.n,
                "deviation": pd.array(deviation, "Int64").repeat(k),
                "whitened": w.ravel(),
                "explained": np.tile(share, len(b)),
                "identity_error": model.identity_error,
            })

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), floored(vector_col, scale).alias("x")).where("x is not null" if k else "false")
    return rows.mapInPandas(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
