"""Calibration windows of each patient, and features standardised by them."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calibration_length(minutes: float, window_s: float, overlap: float) -> int:
    return ceil(minutes * 60 / (window_s * (1 - overlap)))


def mark(rows: DataFrame, n: int, min_windows: int, order: tuple[str, ...] = ("case", "file", "start_sample")) -> DataFrame:
    """is_calibration: the first ``n`` interictal windows before the patient's first ictal one; of all interictal windows if fewer than ``min_windows`` lie before it."""
    whole = Window.partitionBy("patient")
    line = whole.orderBy(*order)
    rows = rows.withColumn("_rn", F.row_number().over(line))
    rows = rows.withColumn("_first", F.min(F.when(F.col("label") == 1, F.col("_rn"))).over(whole))
    early = (F.col("label") == 0) & (F.col("_first").isNull() | (F.col("_rn") < F.col("_first")))
    rows = rows.withColumn("_early", early).withColumn("_n", F.count_if("_early").over(whole))
    candidate = F.when(F.col("_n") < min_windows, F.col("label") == 0).otherwise(F.col("_early"))
    rows = rows.withColumn("_cand", candidate)
    at = F.sum(F.col("_cand").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("is_calibration", F.col("_cand") & (at <= n)).drop("_rn", "_first", "_early", "_n", "_cand")


def standardise(rows: DataFrame, features: list[str], eps: float = 1e-8) -> DataFrame:
    """(x - mean) / max(population std, eps) with the patient's own calibration windows; patients without any keep their values."""
    own = F.col("is_calibration")
    stats = rows.where(own).groupBy("patient").agg(*[F.avg(F.col(f).cast("double")).alias(f"_m_{f}") for f in features], *[F.stddev_pop(F.col(f).cast("double")).alias(f"_s_{f}") for f in features])
    out = rows.join(stats, "patient", "left")
    scaled = {f: F.when(F.col(f"_m_{f}").isNull(), F.col(f).cast("double")).otherwise((F.col(f) - F.col(f"_m_{f}")) / F.greatest(F.col(f"_s_{f}"), F.lit(eps))) for f in features}
    return out.withColumns(scaled).select(*rows.columns)


def arm(rows: DataFrame, features: list[str], name: str, n: int, min_windows: int) -> DataFrame:
    """The rows of an arm with their calibration mask: ``raw`` or ``subject_standardised``."""
    if name not in ("raw", "subject_standardised"):
        raise ValueError(f"unknown arm {name}")
    marked = mark(rows, n, min_windows)
    return standardise(marked, features) if name == "subject_standardised" else marked
