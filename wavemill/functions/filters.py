"""Zero-phase filters of recordings, whole or in chunks: a notch run both ways, then a linear-phase band-pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks as chunked


def bandpass(fs: float, low: float, high: float, ripple_db: float, transition: float) -> np.ndarray:
    """Kaiser-windowed sinc of odd length with unit gain at the centre of the band."""
    beta = 0.1102 * (ripple_db - 8.7) if ripple_db > 50 else 0.5842 * (ripple_db - 21) ** 0.4 + 0.07886 * (ripple_db - 21) if ripple_db > 21 else 0.0
    taps = int(np.ceil((ripple_db - 7.95) / (2.285 * np.pi * transition / (fs / 2)) + 1)) | 1
    t = np.arange(taps) - (taps - 1) / 2
    h = (2 * high / fs * np.sinc(2 * high / fs * t) - 2 * low / fs * np.sinc(2 * low / fs * t)) * np.kaiser(taps, beta)
    return h / (h * np.cos(2 * np.pi * (low + high) / 2 / fs * t)).sum()


def notch(fs: float, f0: float, q: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order notch: zeros on the unit circle at ``f0``, bandwidth ``f0 / q``."""
    w = 2 * np.pi * f0 / fs
    gain = 1 / (1 + np.tan(w / q / 2))
    return gain * np.array([1, -2 * np.cos(w), 1]), np.array([1, -2 * gain * np.cos(w), 2 * gain - 1])


def _convolved(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = len(x) + len(h) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[:n]


def _memory(a: np.ndarray) -> int:
    """After how many samples the recursive filter has forgotten all but 1e-14 of a value; 0 if it never does."""
    radius = np.sqrt(abs(a[2]))
    return int(np.ceil(np.log(1e-14) / np.log(radius))) if 0 < radius < 1 else 0


def halo(fs: float, cfg: dict) -> int:
    """How many samples on each side a filtered sample depends on."""
    return len(bandpass(fs, cfg["low"], cfg["high"], cfg["ripple_db"], cfg["transition"])) // 2 + _memory(notch(fs, cfg["notch"], cfg["q"])[1])


def _both_ways(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The recursive filter forward and backward, from a steady start at odd-reflected edges.

    Its impulse response, which dies out geometrically, is applied by FFT.
    """
    pad = min(3 * max(len(a), len(b)), len(x) - 1)
    edged = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x
    response = np.zeros(_memory(a) or len(edged))
    length = len(response)
    for i in range(length):
        response[i] = (b[i] if i < 3 else 0) - a[1] * (response[i - 1] if i else 0) - a[2] * (response[i - 2] if i > 1 else 0)
    gain = b.sum() / a.sum()

    def once(v: np.ndarray) -> np.ndarray:
        return gain * v[0] + _convolved(v - v[0], response)[: len(v)]

    out = once(once(edged)[::-1])[::-1]
    return out[pad : pad + len(x)] if pad > 0 else out


def apply(x: np.ndarray, fs: float, cfg: dict) -> np.ndarray:
    """One channel of a whole recording, filtered without delay; float32."""
    h = bandpass(fs, cfg["low"], cfg["high"], cfg["ripple_db"], cfg["transition"])
    x = np.asarray(x, float)
    if not len(x):
        return x.astype(np.float32)
    x = _both_ways(x, *notch(fs, cfg["notch"], cfg["q"])) if len(x) > 1 else x
    half = len(h) // 2
    padded = np.pad(x, half, mode="reflect") if len(x) > 1 else np.full(2 * half + 1, x[0])
    return _convolved(padded, h)[2 * half : 2 * half + len(x)].astype(np.float32)


def response(h: np.ndarray, fs: float, freqs) -> np.ndarray:
    """Gain of a filter in dB at some frequencies."""
    t = np.arange(len(h))
    return np.array([20 * np.log10(abs((h * np.exp(-2j * np.pi * f / fs * t)).sum()) + 1e-300) for f in freqs])


def preprocess(chunks: DataFrame, fs: float, cfg: dict, least: int | None = None) -> DataFrame:
    """Chunks (case, file, channel, chunk_idx, start_sample, samples) filtered as if each channel were whole.

    Both filters forget, so a chunk is filtered with the samples on both sides that
    its own depend on (``halo``) and only its own are kept: what comes of a channel
    differs from filtering it at once by no more than rounding. At the ends of a recording
    the edges are what they are for the whole. A row has its number of samples, mean and squared
    deviations, or an error: a bad chunk is a row of the log, not the end of the job.
    """
    reach = halo(fs, cfg)

    def run(batches):
        for b in batches:
            out, stats, error = [], [], []
            for x, lead, n in zip(b["samples"], b["lead"], b["n_samples"], strict=True):
                try:
                    y = apply(np.asarray(x, float), fs, cfg)[lead : lead + n]
                    if not np.isfinite(y).all():
                        raise ValueError("non-finite output")
                    mean = float(y.mean(dtype=float)) if n else 0.0
                    out.append(y)
                    stats.append((mean, float(((y - mean) ** 2).sum(dtype=float))))
                    error.append(None)
                except Exception as e:
                    out.append(None)
                    stats.append((None, None))
                    error.append(f"{type(e).__name__}: {e}")
            keep = b[["case", "file", "channel", "chunk_idx", "start_sample", "n_samples"]]
            yield keep.assign(samples=out, mean=[m for m, _ in stats], squares=[s for _, s in stats], error=error)

    rows = chunked.with_halo(chunks, reach, reach, least)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("case", "file", "channel", "chunk_idx", "start_sample", "n_samples"))
    return rows.mapInPandas(run, f"{schema}, samples array<float>, mean double, squares double, error string")


def channels(filtered: DataFrame, flat: float = 1e-6, loud: float = 5000.0) -> DataFrame:
    """(case, file, channel, n_samples, std, status, error) of the chunks of ``preprocess``: ``success``, ``flat``, ``implausible`` or ``failed``; samples are not read."""
    of = filtered.groupBy("case", "file", "channel").agg(
        F.sum("n_samples").cast("long").alias("n_samples"),
        F.sum(F.col("n_samples") * F.col("mean")).alias("_sum"),
        F.sum(F.col("squares") + F.col("n_samples") * F.col("mean") * F.col("mean")).alias("_squares"),
        F.min("error").alias("error"),
    )
    mean = F.try_divide("_sum", "n_samples")
    std = F.when(F.col("error").isNull(), F.sqrt(F.greatest(F.coalesce(F.try_divide("_squares", "n_samples") - mean * mean, F.lit(0.0)), F.lit(0.0))))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("std") < flat, "flat").when(F.col("std") > loud, "implausible").otherwise("success")
    return of.withColumn("std", std).select("case", "file", "channel", "n_samples", "std", status.alias("status"), "error")
