"""Runs, alarms and event-level results of window predictions.

All of it happens within a recording: windows find runs, and arrays of a recording's
runs become its alarms and seizures, so predictions are shuffled once. The refractory
rule, which depends on the last accepted alarm, is a fold over a recording's alarms
in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import scanned


def runs(pred: DataFrame, keys: list[str], positive: Column, step: int, start: str = "start_sample") -> DataFrame:
    """Runs of neighbouring rows that are positive and exactly one step apart: keys, first, last, n."""
    line = Window.partitionBy(*keys).orderBy(start)
    rows = pred.select(*keys, F.col(start).alias("_s"), F.coalesce(positive, F.lit(False)).alias("_p"))
    line = Window.partitionBy(*keys).orderBy("_s")
    goes_on = F.col("_p") & F.lag("_p", 1, False).over(line) & (F.col("_s") - F.lag("_s").over(line) == step)
    rows = rows.withColumn("_new", F.when(goes_on, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0))).where("_p")
    return rows.groupBy(*keys, "_run").agg(F.min("_s").alias("first"), F.max("_s").alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def merged_alarms(found: DataFrame, keys: list[str], window: int, step: int, min_consecutive: int = 1, merge_gap: int | None = None) -> DataFrame:
    """Alarms of runs that are long enough: keys, raise_sample, end_sample; runs within the gap of the one before join it."""
    gap = step if merge_gap is None else max(step, merge_gap)
    rows = found.where(F.col("n") >= min_consecutive).withColumn("_at", F.col("first") + (min_consecutive - 1) * step)
    line = Window.partitionBy(*keys).orderBy("_at")
    joins = F.col("_at") - F.lag("last").over(line) <= gap
    rows = rows.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("_alarm", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_alarm").agg((F.min("_at") + window).alias("raise_sample"), (F.max("last") + window).alias("end_sample")).drop("_alarm")


def _rested(alarms: Column, refractory: int) -> Column:
    """Of a recording's alarms in order, those raised at least ``refractory`` samples after the last accepted one."""
    def accept(state: Column, a: Column) -> tuple[dict[str, Column], Column, Column]:
        late = state["last"].isNull() | (a["raise_sample"] - state["last"] >= refractory)
        return {"last": F.when(late, a["raise_sample"]).otherwise(state["last"])}, a, late

    return scanned(alarms, {"last": F.lit(None).cast("long")}, accept, "struct<raise_sample:bigint,end_sample:bigint>")


def refractory_alarms(alarms: DataFrame, keys: list[str], refractory: int) -> DataFrame:
    """Drop alarms raised less than ``refractory`` samples after the last accepted one of their recording."""
    if refractory <= 0:
        return alarms
    listed = alarms.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("raise_sample", "end_sample"))).alias("_a"))
    kept = listed.select(*keys, F.explode(_rested(F.col("_a"), refractory)).alias("_k"))
    return kept.select(*keys, "_k.raise_sample", "_k.end_sample")


def validate(pred: DataFrame, step_s: float, min_consecutive: int, refractory_s: float) -> None:
    """Raise for missing columns, impossible options, and rows that repeat a window."""
    if missing := [c for c in ("case", "file", "start_sample", "y_true", "y_pred") if c not in pred.columns]:
        raise ValueError(f"predictions lack {missing}")
    if step_s <= 0 or min_consecutive < 1 or refractory_s < 0:
        raise ValueError("step_s must be positive, min_consecutive at least 1, refractory_s not negative")
    keys = [c for c in ("arm", "model", "patient", "case", "file", "start_sample") if c in pred.columns]
    if not pred.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("predictions repeat a window")


def by_recording(pred: DataFrame, keys: list[str], window: int, step: int, min_consecutive: int = 1, merge_gap: int | None = None, refractory: int = 0) -> DataFrame:
    """A row per recording: keys, n_windows, its alarms (raise_sample, end_sample, in_seizure) and its seizures (onset_sample, end_sample, alarm_raise_sample), in order."""
    gap = step if merge_gap is None else max(step, merge_gap)
    line = Window.partitionBy(*keys).orderBy("_s")
    flag = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    rows = pred.select(*keys, F.col("start_sample").alias("_s"), flag("y_true").alias("_t"), flag("y_pred").alias("_p"))
    beside = {f"{way}{c}": f(c, 1, False).over(line) for c in ("_t", "_p") for way, f in (("_was", F.lag), ("_is", F.lead))} | {"_was_s": F.lag("_s").over(line), "_is_s": F.lead("_s").over(line)}
    rows = rows.withColumns(beside)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    new = lambda c: F.col(c) & ~(F.col(f"_was{c}") & F.coalesce(F.col("_s") - F.col("_was_s") == step, F.lit(False)))
    last = lambda c: F.col(c) & ~(F.col(f"_is{c}") & F.coalesce(F.col("_is_s") - F.col("_s") == step, F.lit(False)))
    rows = rows.withColumns({f"_begin{c}": F.max(F.when(new(c), F.col("_s"))).over(upto) for c in ("_t", "_p")})
    run = lambda c: F.array_sort(F.collect_list(F.when(last(c), F.struct(F.col(f"_begin{c}").alias("first"), F.col("_s").alias("last")))))
    rows = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"), run("_t").alias("_true"), run("_p").alias("_positive"))
    enough = F.filter("_positive", lambda r: r["last"] - r["first"] >= (min_consecutive - 1) * step)
    rows = rows.withColumn("_runs", F.transform(enough, lambda r: F.struct((r["first"] + (min_consecutive - 1) * step).alias("at"), r["last"].alias("last"))))
    apart = F.transform("_runs", lambda r, i: F.when((i == 0) | (r["at"] - F.get(F.col("_runs"), i - 1)["last"] > gap), i))
    rows = rows.withColumn("_firsts", F.filter(apart, lambda i: i.isNotNull()))
    until = lambda j: F.coalesce(F.get(F.col("_firsts"), j + 1), F.size("_runs")) - 1
    rows = rows.withColumn("_alarms", F.transform("_firsts", lambda i, j: F.struct((F.get(F.col("_runs"), i)["at"] + window).alias("raise_sample"), (F.get(F.col("_runs"), until(j))["last"] + window).alias("end_sample"))))
    if refractory > 0:
        rows = rows.withColumn("_alarms", _rested(F.col("_alarms"), refractory))
    seizures = F.transform("_true", lambda r: F.struct(r["first"].alias("onset_sample"), (r["last"] + window).alias("end_sample")))
    rows = rows.withColumn("_seizures", seizures)
    within = lambda a, s: a["raise_sample"].between(s["onset_sample"], s["end_sample"])
    alarms = F.transform("_alarms", lambda a: F.struct(a["raise_sample"].alias("raise_sample"), a["end_sample"].alias("end_sample"), F.exists("_seizures", lambda s: within(a, s)).alias("in_seizure")))
    first_alarm = lambda s: F.array_min(F.transform(F.filter("_alarms", lambda a: within(a, s)), lambda a: a["raise_sample"]))
    seizures = F.transform("_seizures", lambda s: F.struct(s["onset_sample"].alias("onset_sample"), s["end_sample"].alias("end_sample"), first_alarm(s).alias("alarm_raise_sample")))
    return rows.select(*keys, "n_windows", alarms.alias("alarms"), seizures.alias("seizures"))


def tables(pred: DataFrame, by: list[str], fs: float, window_s: float, step_s: float, min_consecutive: int = 1, merge_gap_s: float | None = None, refractory_s: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summary per ``by``, seizures, and alarms. Undefined rates and latencies are null."""
    keys = [*by, "case", "file"]
    gap = None if merge_gap_s is None else round(merge_gap_s * fs)
    whole = by_recording(pred, keys, round(window_s * fs), round(step_s * fs), min_consecutive, gap, round(refractory_s * fs))
    seen = whole.select(*keys, F.explode("seizures").alias("s")).select(*keys, "s.*")
    latency = lambda s: (s["alarm_raise_sample"] - s["onset_sample"]) / float(fs)
    seen = seen.withColumns({"detected": F.col("alarm_raise_sample").isNotNull(), "latency_s": latency(seen)})
    flagged = whole.select(*keys, F.explode("alarms").alias("a")).select(*keys, "a.*")
    # a row per detected seizure, or one for a recording without any; counts are in the first
    found = F.filter("seizures", lambda s: s["alarm_raise_sample"].isNotNull())
    per = whole.select(*by, "n_windows", F.size("seizures").alias("_s"), F.size(found).alias("_d"), F.size("alarms").alias("_a"), F.size(F.filter("alarms", lambda a: ~a["in_seizure"])).alias("_f"), F.posexplode_outer(F.transform(found, latency)).alias("_i", "_latency"))
    once = lambda c: F.sum(F.when(F.coalesce("_i", F.lit(0)) == 0, F.col(c)).otherwise(0)).cast("long")
    sums = per.groupBy(*by).agg(
        once("_s").alias("n_seizures"), once("_d").alias("n_detected"), once("_a").alias("n_alarms"), once("_f").alias("n_false_alarms"),
        (once("n_windows") * step_s / 3600.0).alias("hours_scored"), F.median("_latency").alias("median_latency_s"), F.avg("_latency").alias("mean_latency_s"),
    )
    summary = sums.select(
        *by,
        "n_seizures",
        "n_detected",
        F.try_divide("n_detected", "n_seizures").alias("event_sensitivity"),
        "n_alarms",
        "n_false_alarms",
        "hours_scored",
        F.try_divide("n_false_alarms", "hours_scored").alias("fa_per_hour_event"),
        "median_latency_s",
        "mean_latency_s",
    )
    return summary, seen, flagged


def report(summary: DataFrame) -> DataFrame:
    """Per arm and model: seizures, detections, means over patients, and the median of their median latencies."""
    return summary.groupBy("arm", "model").agg(
        F.sum("n_seizures").alias("n_seizures"),
        F.sum("n_detected").alias("n_detected"),
        F.round(F.avg("event_sensitivity"), 3).alias("mean_sensitivity"),
        F.round(F.avg("fa_per_hour_event"), 3).alias("mean_fa_per_hour"),
        F.round(F.median("median_latency_s"), 3).alias("median_latency_s"),
    )
