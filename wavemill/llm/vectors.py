"""Whole numbers of embedding vectors, and exact sums over tables of them.

A sum is added up where the rows lie, in 64-bit integers for as long as they
hold it, and leaves a task as rows ``(i, j, value)``: as many as the sum has
entries, however many rows the task has read. These few rows are grouped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below this, products of two components add up exactly in doubles over a batch.
EXACT = 2.0**53
LOW = 2**62 - 1


def floored(vector_col: str, scale: float) -> Column:
    """floor(scale * component) of each component, null where the vector is null or a component is null or not finite."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    whole = F.col(vector_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(whole, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def stacked(column: pd.Series, dims: int) -> np.ndarray:
    """The arrays of a column as the rows of a matrix of 64-bit integers; shorter ones end in zeros."""
    out = np.zeros((len(column), dims), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def wide(x: np.ndarray) -> np.ndarray:
    """The same numbers as integers without bounds."""
    return x.astype(object)


def moved(x: np.ndarray, by: list[int]) -> np.ndarray:
    """x - by, exact."""
    if len(x) and max(float(np.abs(x.astype(float)).max(initial=0)), *(abs(float(v)) for v in by)) < 2.0**61:
        return x - np.array(by, np.int64)
    return wide(x) - np.array(by, object)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a^T b of whole numbers; 64-bit where every sum fits, else without bounds."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * len(a)
    if most < EXACT:
        return (a.astype(float).T @ b.astype(float)).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64).T @ b.astype(np.int64)
    return wide(a).T @ wide(b)


def added(df: DataFrame, column: str, dims: int, of: Callable[[np.ndarray], np.ndarray]) -> dict[tuple[int, int], int]:
    """Sums over all rows of ``of(matrix of a batch)``, a matrix of whole numbers with as many entries for every batch.

    The driver gets one number for each entry, so ``of`` must not grow with the table.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                part = wide(of(stacked(b[column], dims)))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "high": [str(v >> 62) for v in total.ravel()], "low": [str(v & LOW) for v in total.ravel()]})

    parts = df.select(column).mapInPandas(run, "i int, j int, high string, low string")
    found = parts.groupBy("i", "j").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    return {(r["i"], r["j"]): (int(r["high"]) << 62) + int(r["low"]) for r in found.collect()}
