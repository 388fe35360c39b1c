"""What adaptive filters keep of the contrast between seizure and background."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import METHODS, tag
from ..functions import adaptive, kernels, segmented
from ..operators import metrics
from ..shared import kept
from .bindings import STEP


def contrast(pred: DataFrame, before: int = 5) -> DataFrame:
    """Per seizure run: squared scores (in hundredths) inside it and in the ``before`` windows ahead of it, and the ratio of their means."""
    line = Window.partitionBy("file").orderBy("start_sample")
    ahead = line.rowsBetween(-before, -1)
    cents = F.round(F.col("y_score") * 100).cast("long")  # whole numbers add up exactly in any order
    rows = pred.withColumn("power", cents * cents).withColumns({"b_sum": F.sum("power").over(ahead), "b_n": F.count("power").over(ahead)})
    goes_on = (F.col("y_true") == 1) & (F.lag("y_true", 1, 0).over(line) == 1) & (F.col("start_sample") - F.lag("start_sample").over(line) == STEP)
    rows = rows.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0))).where("y_true = 1")
    runs = rows.groupBy("file", "run").agg(F.min("start_sample").alias("onset_sample"), F.sum("power").alias("power_inside"), F.count(F.lit(1)).alias("n_inside"), F.min_by("b_sum", "start_sample").alias("power_before"), F.min_by("b_n", "start_sample").alias("n_before"))
    ratio = F.try_divide(F.col("power_inside") / F.col("n_inside"), F.try_divide("power_before", "n_before"))
    return runs.select("file", "onset_sample", "power_inside", "n_inside", "power_before", "n_before", F.round(ratio, 4).alias("contrast"))


def cheap_features(fs: float):
    """Arrow UDF: the fifteen screening features of windows of one length."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(kernels.screening_features(np.stack([np.asarray(v, float) for v in b]), fs))) if len(b) else pd.Series([], dtype=object)

    return run


def separability(windows: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """Mean of 2 |AUC - 0.5| over the screening features, per group of (keys, label, x)."""
    return _separability(windows.withColumn("_f", cheap_features(fs)("x")), keys)


def _separability(rows: DataFrame, keys: list[str]) -> DataFrame:
    aucs = metrics.auc(rows.select(*keys, "label", F.posexplode("_f").alias("feature", "value")), [*keys, "feature"], "label", "value")
    return aucs.groupBy(*keys).agg(F.avg(2 * F.abs(F.col("auc") - 0.5)).alias("separability"))


def _features_after(chunks: DataFrame, settings: list[tuple[str, dict]], fs: float, warm_start_s: float = 4.0) -> DataFrame:
    """(method, tag, case, chunk_idx, _f) of each setting: NLMS and RLS in segments side by side, the amplitude filter and what segments cannot give in the order of the chunks."""
    names = ["method", "tag", "case", "chunk_idx"]
    named = lambda df, method, params: df.select(F.lit(method).alias("method"), F.lit(tag(method, params)).alias("tag"), "case", "chunk_idx", F.col("samples").alias("x"))
    in_order = lambda rows, method, params: named(adaptive.run(rows, method, params, fs=fs, warm_start_s=warm_start_s), method, params)
    whole = F.size("samples").isNotNull() & (F.size("samples") > 0) & ~F.exists("samples", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    odd = [r["case"] for r in chunks.where(~F.coalesce(whole, F.lit(False))).select("case").distinct().collect()]
    sided = [(m, p) for m, p in settings if m in ("nlms", "rls")]
    parts = [in_order(chunks, m, p) for m, p in settings if (m, p) not in sided]
    if odd:
        parts += [in_order(chunks.where(F.col("case").isin(odd)), m, p) for m, p in sided]
    done = None
    if sided:
        found = segmented.run(chunks.where(~F.col("case").isin(odd)), sided, fs, warm_start_s)
        labels = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(tag(m, p)).alias("tag")) for m, p in sided])
        found = found.select("setting", labels[F.col("setting")].alias("s"), "case", "chunk_idx", cheap_features(fs)("samples").alias("_f"), "capped")
        done = kept(found.select("setting", "s.method", "s.tag", "case", "chunk_idx", "_f", "capped"))
        capped = done.where("capped").select("setting", "case").distinct()
        again: dict[int, list[str]] = {}
        for r in capped.collect():
            again.setdefault(r["setting"], []).append(r["case"])
        if again:
            done = done.join(F.broadcast(capped), ["setting", "case"], "left_anti")
            parts += [in_order(chunks.where(F.col("case").isin(cases)), *sided[k]) for k, cases in again.items()]
        done = done.select(*names, "_f")
    rest = [p.select(*names, cheap_features(fs)("x").alias("_f")) for p in parts]
    return reduce(DataFrame.union, [*([done] if done is not None else []), *rest])


def separability_kept(windows: DataFrame, fs: float = 64.0, settings: list[tuple[str, dict]] | None = None, threshold: float = 0.85) -> DataFrame:
    """Per setting: separability of the labels before and after the filter, the least kept by a patient, and whether it passes."""
    chunks = windows.select(F.col("patient").cast("string").alias("case"), F.lit("C1").alias("channel"), F.lit("all").alias("file"), F.lit(1).alias("file_order"), F.col("vec_id").alias("chunk_idx"), F.col("x").alias("samples"))
    labels = windows.select(F.col("vec_id").alias("chunk_idx"), "label")
    before = separability(windows.select(F.col("patient").cast("string").alias("case"), "label", "x"), ["case"], fs).withColumnRenamed("separability", "sep_in")
    filtered = _features_after(chunks, settings or [(m, {}) for m in METHODS], fs)
    after = _separability(filtered.join(labels, "chunk_idx"), ["method", "tag", "case"])
    by_case = after.join(before, "case").withColumn("kept", F.try_divide("separability", "sep_in"))
    worst = by_case.groupBy("method", "tag").agg(F.round(F.avg("sep_in"), 6).alias("sep_in"), F.round(F.avg("separability"), 6).alias("sep_out"), F.round(F.min("kept"), 6).alias("worst_kept"))
    return worst.withColumn("passes", F.col("worst_kept") >= threshold)


def kept_power(before: DataFrame, after: DataFrame, fs: float, background_s: float = 60.0, tail_s: float = 10.0, gap_s: float = 5.0, post_s: float = 30.0) -> DataFrame:
    """Per (case, channel): how much of the burst's power over the background's a filter keeps, in the whole burst, its tail, and after it.

    ``before`` has onset and end; both have whole samples.
    """
    power = lambda x, a, b: F.transform(F.array(F.slice(x, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))), lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e) / F.size(v))[0]
    rows = before.select("case", "channel", "onset", "end", F.col("samples").alias("i")).join(after.select("case", "channel", F.col("samples").alias("o")), ["case", "channel"])
    on, end = F.col("onset"), F.col("end")
    tail = F.least(F.lit(int(tail_s * fs)), F.floor((end - on) / 2))
    post_end = F.least(F.size("i").cast("long"), end + int((gap_s + post_s) * fs))

    def ratio(a, b):
        one = lambda x: F.try_divide(power(x, a, b), power(x, F.greatest(on - int(background_s * fs), F.lit(0)), on))
        return F.try_divide(one(F.col("o")), one(F.col("i")))

    post = F.when(post_end > end + int(gap_s * fs), ratio(end + int(gap_s * fs), post_end))
    return rows.select("case", "channel", ratio(on, end).alias("kept_mean"), ratio(end - tail, end).alias("kept_tail"), post.alias("post_ratio"))
