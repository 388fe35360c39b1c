"""Centroid clustering over a VA-file: few-bit cells decide, vectors are opened only where the cells leave it open.

Each vector is stored as the cells that its components fall into, ``bits`` bits a
dimension, beside its components. A lookup table for each dimension and cell holds the least
and greatest squared distance to each centroid; added up they bound the distance of a vector to every centroid.
Centroids whose lower bound is above the smallest upper bound are out. For the rest the cells also bound how much
farther each centroid is than the most promising one, which is linear in every component and therefore much
tighter than two separate bounds. Where one centroid is left it is the nearest, and the vector stays closed; else
the vector is opened and compared exactly, with whole numbers, to the centroids that are left.

A round reads the file once and writes nothing but sums: of each vector it finds the
nearest centroid before and after the last update, and only those that went from one cluster to another (all, at first)
are opened to move their components between the two clusters' exact sums. A task returns one sum per cluster and
dimension. The driver holds centroids and sums, k x dims numbers each. Cells are cut at approximate
quantiles over all rows; they steer the work, never the result.

Defined cases: vectors that are null, hold null or non-finite components, or have
another length take no part; ids may be null (such rows start no centroid as long as others can) or repeat, each row gets
its own result; with fewer than ``k`` vectors there are fewer centroids, with none no
rows; equal centroids leave the larger number empty; an empty cluster keeps its
centroid; where distances may pass 2**53 all vectors are opened and compared as integers
without bounds; a distance or sum that does not fit a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import kept
from .vectors import floored, stacked, wide

#: Distances and bounds below this are exact in doubles.
EXACT = 2.0**53
#: Vectors compared at once.
AT_ONCE = 2048
LONG = 2**63 - 1


def pack(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of cell numbers as rows of bytes, ``bits`` bits each."""
    ones = (codes[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1
    return np.packbits(ones.reshape(len(codes), codes.shape[1] * bits).astype(np.uint8), axis=1)


def unpack(packed: np.ndarray, bits: int, dims: int) -> np.ndarray:
    ones = np.unpackbits(packed, axis=1)[:, : bits * dims].reshape(len(packed), dims, bits)
    return ones @ (1 << np.arange(bits - 1, -1, -1))


class Cells:
    """Borders of the cells of each dimension: cell c holds low[c] to high[c]."""

    def __init__(self, borders: list[list[int]], least: list[int], most: list[int]):
        self.inner = [np.array(sorted({b for b in row if lo < b <= hi}), np.int64) for row, lo, hi in zip(borders, least, most, strict=True)]
        self.low = [np.concatenate([[lo], b]) for b, lo in zip(self.inner, least, strict=True)]
        self.high = [np.concatenate([b - 1, [hi]]) for b, hi in zip(self.inner, most, strict=True)]

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, x[:, j], side="right") for j, b in enumerate(self.inner)], axis=1)

    def tables(self, centroids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each dimension the least and greatest squared distance of a cell (row) to a centroid's component (column)."""
        least, most = [], []
        for j, (lo, hi) in enumerate(zip(self.low, self.high, strict=True)):
            c, lo, hi = centroids[:, j].astype(float), lo[:, None].astype(float), hi[:, None].astype(float)
            least.append(np.maximum(np.maximum(lo - c, c - hi), 0.0) ** 2)
            most.append(np.maximum(np.abs(lo - c), np.abs(hi - c)) ** 2)
        return least, most


class Judge:
    """Finds nearest centroids: by cells where these decide, else by opened vectors."""

    def __init__(self, cells: Cells | None, centroids: list[list[int]]):
        self.cells = cells
        self.exact = np.array(centroids, object)
        if cells is not None:
            self.c = self.exact.astype(float)
            self.least, self.most = cells.tables(self.c)
            self.norm = (self.c**2).sum(1)

    def left(self, codes: np.ndarray) -> np.ndarray:
        """Which centroids may be nearest to each vector."""
        k, n = len(self.exact), len(codes)
        if self.cells is None:
            return np.ones((n, k), bool)
        lower, upper = np.zeros((n, k)), np.zeros((n, k))
        for j in range(codes.shape[1]):
            lower += self.least[j][codes[:, j]]
            upper += self.most[j][codes[:, j]]
        may = lower <= upper.min(1)[:, None]
        open_ = np.flatnonzero(may.sum(1) > 1)
        if len(open_):
            lo = np.stack([self.cells.low[j][codes[open_, j]] for j in range(codes.shape[1])], 1).astype(float)
            hi = np.stack([self.cells.high[j][codes[open_, j]] for j in range(codes.shape[1])], 1).astype(float)
            c = self.c
            likely = np.where(may[open_], self.norm - (lo + hi) @ c.T, np.inf).argmin(1)
            for b in np.unique(likely):
                own = likely == b
                w = c - c[b]
                # |x - a|^2 - |x - b|^2 = |a|^2 - |b|^2 - 2 x (a - b): least at one end of each cell
                farther = self.norm - self.norm[b] - 2 * (hi[own] @ np.maximum(w, 0).T + lo[own] @ np.minimum(w, 0).T)
                may[open_[own]] &= farther <= 0  # at 0 it may be as near, and then the number decides
        return may

    def nearest(self, may: np.ndarray, vectors: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, int]:
        """Number of each vector's nearest centroid, and how many vectors were opened."""
        found = may.argmax(1)
        open_ = np.flatnonzero(may.sum(1) > 1)
        if len(open_):
            found[open_] = np.where(may[open_], self.distances(vectors(open_)), np.inf if self.cells is not None else 10**60).argmin(1)
        return found, len(open_)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Exact squared distances."""
        if self.cells is None:
            return ((wide(x)[:, None, :] - self.exact[None]) ** 2).sum(2)
        x = x.astype(float)
        return (x**2).sum(1)[:, None] - 2 * (x @ self.c.T) + self.norm


def _filed(cells: Cells | None, bits: int, dims: int):
    """Vectors beside their packed cells; 32-bit components where these hold them."""
    kind = np.int32 if cells is not None else np.int64

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = stacked(b["x"], dims)
            packed = pack(cells.codes(x), bits) if cells is not None else np.zeros((len(x), 0), np.uint8)
            yield pd.DataFrame({"vec_id": b["vec_id"], "cells": [r.tobytes() for r in packed], "vector": [r.tobytes() for r in x.astype(kind)]})

    return run


def _read(b: pd.DataFrame, bits: int, dims: int, narrow: bool):
    """Cells of a batch, and how to open some of its vectors."""
    packed = b["cells"].to_numpy()
    codes = unpack(np.frombuffer(b"".join(packed), np.uint8).reshape(len(b), -1), bits, dims) if narrow else np.zeros((len(b), dims), np.int64)
    stored = b["vector"].to_numpy()
    return codes, lambda at: np.frombuffer(b"".join(stored[at]), np.int32 if narrow else np.int64).reshape(len(at), dims)


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), AT_ONCE):
            yield b.iloc[at : at + AT_ONCE]


def _round(now: Judge, before: Judge | None, bits: int, dims: int, k: int):
    """What changes in the clusters' counts and sums, and how many vectors were opened: (cluster, dim, value), dim -1 for the count, cluster -1 for the opened."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, dims + 1), object)
        opened = n = 0
        for b in _slices(batches):
            codes, vectors = _read(b, bits, dims, now.cells is not None)
            new, n_open = now.nearest(now.left(codes), vectors)
            old = before.nearest(before.left(codes), vectors)[0] if before else np.full(len(new), -1)
            gone = np.flatnonzero(new != old)
            x = vectors(gone)
            moved = np.concatenate([wide(x) if now.cells is None else x.astype(np.int64), np.ones((len(gone), 1), np.int64)], axis=1)
            part = np.zeros((k, dims + 1), object if now.cells is None else np.int64)
            np.add.at(part, new[gone], moved)
            was = old[gone] >= 0
            np.subtract.at(part, old[gone][was], moved[was])
            total = total + part
            opened, n = opened + n_open, n + len(b)
        if n:
            c, d = np.nonzero(total)
            yield pd.DataFrame({"cluster": [*c, -1, -1], "dim": [*d, 0, 1], "value": [*(str(v) for v in total[c, d]), str(opened), str(n)]})

    return run


def _final(judge: Judge, bits: int, dims: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _slices(batches):
            codes, vectors = _read(b, bits, dims, judge.cells is not None)
            found, _ = judge.nearest(judge.left(codes), vectors)
            own = wide(vectors(np.arange(len(b)))) - judge.exact[found]  # the distance itself needs every vector
            distance = [v if v <= LONG else None for v in (own**2).sum(1)] if judge.cells is None else (own.astype(np.int64) ** 2).sum(1)
            yield pd.DataFrame({"vec_id": b["vec_id"], "cluster": found.astype(np.int32), "distance": pd.array(distance, "Int64")})

    return run


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, bits: int = 6, salt: str = "2:", counts: dict | None = None) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every vector of ``dims`` components of floor(scale * x), and the final centroids.

    The first centroids are the ``k`` vectors with the smallest SHA-256 of ``salt`` and the id. ``counts``, if given, gets
    for each round how many vectors were opened to find their nearest centroid, and of how many.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), floored(vector_col, scale).alias("x")).where((F.size("x") == dims) & F.col("x").isNotNull())
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    centroids = [list(r["x"]) for r in rows.orderBy(digest.asc_nulls_last(), "x").limit(k).collect()]
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    k = len(centroids)
    at = lambda j: F.element_at("x", j + 1)
    marks = [i / 2**bits for i in range(1, 2**bits)]
    seen = rows.agg(*[F.min(at(j)).alias(f"l{j}") for j in range(dims)], *[F.max(at(j)).alias(f"m{j}") for j in range(dims)], *[F.percentile_approx(at(j), marks, 1 << (bits + 4)).alias(f"q{j}") for j in range(dims)]).first()
    least, most = [seen[f"l{j}"] for j in range(dims)], [seen[f"m{j}"] for j in range(dims)]
    exact = 8 * dims * max(map(abs, [*least, *most])) ** 2 < EXACT
    cells = Cells([seen[f"q{j}"] for j in range(dims)], least, most) if exact else None
    filed = kept(rows.mapInPandas(_filed(cells, bits, dims), "vec_id long, cells binary, vector binary"))
    sums, sizes = [[0] * dims for _ in range(k)], [0] * k
    before = None
    for turn in range(rounds):
        now = Judge(cells, centroids)
        changes = filed.mapInPandas(_round(now, before, bits, dims, k), "cluster int, dim int, value string")
        for r in changes.groupBy("cluster", "dim").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
            c, d, v = r["cluster"], r["dim"], int(r["value"])
            if c < 0:
                if counts is not None:
                    counts.setdefault(turn, {})["rows" if d else "opened"] = v
            elif d < dims:
                sums[c][d] += v
            else:
                sizes[c] += v
        before = now
        centroids = [[s // n for s in row] if n else old for row, n, old in zip(sums, sizes, centroids, strict=True)]
    return filed.mapInPandas(_final(Judge(cells, centroids), bits, dims), "vec_id long, cluster int, distance long"), centroids


def inertias(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``cluster_inertia``, ``inertia`` and ``centroid_sha256`` beside each row of ``cluster``."""
    spark = assigned.sparkSession
    assigned = kept(assigned)
    own = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # a row for each centroid
    whole = sum(int(v) for v in own.values() if v is not None)
    fits = lambda v: int(v) if v is not None and v <= LONG else None
    told = [(c, fits(v), fits(whole), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, v in own.items()]
    return assigned.join(F.broadcast(spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster")
