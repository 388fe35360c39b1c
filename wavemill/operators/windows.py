"""Overlapping windows of recordings, and their labels from seizure intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import with_halo


def cut(recordings: DataFrame, length: int, step: int, fs: float, n_samples: str = "n_samples") -> DataFrame:
    """One row per window: the columns of ``recordings`` with start_sample and t_start_s; a recording shorter than a window has none."""
    if step <= 0:
        raise ValueError("the step must be positive")
    starts = F.when(F.col(n_samples) >= length, F.sequence(F.lit(0).cast("long"), F.col(n_samples).cast("long") - length, F.lit(step).cast("long")))
    return recordings.withColumn("start_sample", F.explode(starts)).withColumn("t_start_s", F.col("start_sample") / float(fs))


def labelled(recordings: DataFrame, seizures: DataFrame, length: int, step: int, fs: float, drop_boundary: bool = True, key: str = "file") -> DataFrame:
    """Windows with label 1 inside a seizure, 0 outside all, and those across an edge dropped (or 1).

    ``seizures`` (key, onset_sample, end_sample; half-open) becomes one array per
    recording before the windows are cut, so labels need no join or grouping of windows.
    """
    listed = seizures.groupBy(key).agg(F.collect_list(F.struct("onset_sample", "end_sample")).alias("_iv"))
    rows = cut(recordings.join(listed, key, "left"), length, step, fs)
    begin, end = F.col("start_sample"), F.col("start_sample") + length
    inside = F.coalesce(F.exists("_iv", lambda v: (begin >= v["onset_sample"]) & (end <= v["end_sample"])), F.lit(False))
    touches = F.coalesce(F.exists("_iv", lambda v: (end > v["onset_sample"]) & (begin < v["end_sample"])), F.lit(False))
    label = F.when(inside, 1).when(~touches, 0)
    if not drop_boundary:
        label = F.when(inside | touches, 1).otherwise(0)
    out = rows.withColumn("label", label.cast("tinyint")).drop("_iv")
    return out.where("label is not null") if drop_boundary else out


def sample_bounds(annotations: DataFrame, fs: float) -> DataFrame:
    """Seizure times in seconds to samples, rounded half to even."""
    return annotations.withColumns({"onset_sample": F.bround(F.col("seizure_start_s") * float(fs)).cast("long"), "end_sample": F.bround(F.col("seizure_end_s") * float(fs)).cast("long")})


def counts(windows: DataFrame) -> DataFrame:
    """Per patient: windows, ictal ones, their share; and patients without any are told by n_ictal = 0."""
    return windows.groupBy("patient").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col("label") == 1).alias("n_ictal"), F.avg(F.col("label").cast("double")).alias("ictal_fraction"))


def slices(signals: DataFrame, length: int, step: int, fs: float) -> DataFrame:
    """One row per window and channel of whole recordings (samples ARRAY): keys, start_sample, t_start_s, x."""
    rows = cut(signals.withColumn("_n", F.size("samples")), length, step, fs, "_n")
    return rows.withColumn("x", F.slice("samples", (F.col("start_sample") + 1).cast("int"), length)).drop("samples", "_n")


def chunk_slices(chunks: DataFrame, length: int, step: int, fs: float, keys: tuple[str, ...] = ("case", "file", "channel"), least: int | None = None) -> DataFrame:
    """The windows of ``slices`` from chunks (keys, chunk_idx, start_sample, samples) of recordings.

    A window belongs to the chunk that its first sample lies in, which borrows what
    the window needs of the chunks that follow (``with_halo``).
    """
    if step <= 0:
        raise ValueError("the step must be positive")
    rows = with_halo(chunks, 0, length - 1, least, keys)
    first = F.ceil(F.col("start_sample") / step).cast("long") * step
    last = F.col("start_sample") + F.least(F.col("n_samples").cast("long") - 1, F.size("samples").cast("long") - length)  # no window reaches beyond the recording
    starts = F.when(last >= first, F.sequence(first, last, F.lit(step).cast("long")))
    rows = rows.select(*keys, F.col("start_sample").alias("_begin"), "samples", F.explode(starts).alias("start_sample"))
    return rows.select(*keys, "start_sample", (F.col("start_sample") / float(fs)).alias("t_start_s"), F.slice("samples", (F.col("start_sample") - F.col("_begin") + 1).cast("int"), length).alias("x"))
