"""Feature table of windows: one Arrow UDF for sums, spectra, entropies and wavelets, expressions for what follows from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import NONLINEAR, TIME_DOMAIN, feature_names, slug
from . import kernels, time_domain


def spectral(fs: float, nonlinear: bool = True):
    """Arrow UDF from ARRAY<DOUBLE> windows to the summary of the time domain and the features after it, as an array in catalogue order."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = pd.Series([None] * len(batch), dtype=object)
            sizes = batch.map(len).to_numpy()
            for n in np.unique(sizes):  # windows of one length make one matrix
                at = np.flatnonzero(sizes == n)
                x = np.stack([np.asarray(batch.iloc[i], float) for i in at]) if n else np.zeros((len(at), 0))
                parts = [kernels.time_domain_summary(x), kernels.frequency_features(x, fs), *([kernels.entropies(x)] if nonlinear else []), kernels.wavelet_features(x)]
                for i, row in zip(at, np.hstack(parts), strict=True):
                    out.iloc[i] = row
            yield out

    return run


def with_features(windows: DataFrame, fs: float, x: str = "x", nonlinear: bool = True) -> DataFrame:
    """One FLOAT column per feature in place of the samples; undefined values are 0 and counted in n_non_finite."""
    samples = F.transform(x, lambda v: v.cast("double"))
    rows = windows.withColumn("_rest", spectral(fs, nonlinear)(samples))
    part = lambda i, name: F.col("_rest")[i].alias(name)
    of = F.struct(*[part(i, name) for i, name in enumerate(("mean", "m2", "m3", "m4"))]).alias("of")
    rows = rows.withColumn("_td", F.struct(of, part(4, "line_length"), part(5, "d1"), part(6, "d2")))
    names = [n for n in feature_names(nonlinear) if n not in TIME_DOMAIN]
    values = time_domain.features(F.col("_td")) | {n: F.col("_rest")[i] for i, n in enumerate(names, start=7)}
    bad: Callable = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    raw = rows.withColumns({f"_f_{n}": values[n] for n in feature_names(nonlinear)})
    cols = {n: F.when(bad(F.col(f"_f_{n}")), F.lit(0.0)).otherwise(F.col(f"_f_{n}")).cast("float") for n in feature_names(nonlinear)}
    count: Column = sum((bad(F.col(f"_f_{n}")).cast("int") for n in feature_names(nonlinear)), F.lit(0))
    keep = [c for c in windows.columns if c != x]
    return raw.select(*keep, *[c.alias(n) for n, c in cols.items()], count.alias("n_non_finite"))


def wide(features: DataFrame, keys: list[str], channels: list[str], nonlinear: bool = True) -> DataFrame:
    """One row per window with a column per feature and channel, for learning; until then the table stays one row per channel."""
    names = feature_names(nonlinear)
    per = features.groupBy(*keys).pivot("channel", channels).agg(*[F.first(n).alias(n) for n in names])
    return per.select(*keys, *[F.col(f"`{c}_{n}`").alias(f"f_{n}_{slug(c)}") for n in names for c in channels])


def counted(features: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows, and how many there are and how many of their values were replaced, known once they are written."""
    seen = Observation()
    return features.observe(seen, F.coalesce(F.sum("n_non_finite"), F.lit(0)).alias("replaced"), F.count(F.lit(1)).alias("n")), seen


def share_non_finite(replaced: int, rows: int, n_features: int = len(feature_names())) -> dict:
    """How many values were replaced, of how many, and whether that is more than one in a thousand."""
    values = rows * n_features
    return {"replaced": replaced, "values": values, "warn": replaced / values > 0.001 if values else None}


__all__ = ["NONLINEAR", "counted", "share_non_finite", "spectral", "wide", "with_features"]
