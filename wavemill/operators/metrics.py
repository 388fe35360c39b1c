"""Window-level metrics: confusion, rates, exact ROC-AUC, and their summaries over patients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept, running

METRICS = ["sensitivity", "specificity", "f1", "auc", "fa_per_hour"]


def auc(rows: DataFrame, keys: list[str], label: str, score: str, name: str = "auc", spread: bool = False) -> DataFrame:
    """Exact area under the ROC curve per group: ties take the average rank. Null if a class is missing.

    Scores are first counted per distinct value, which is all that ranks need. With
    ``spread`` the values of a group are ranked over range partitions, for few
    groups with many values; without it each group is sorted in one task.
    """
    values = rows.groupBy(*keys, F.col(score).alias("_v")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count(F.lit(1)).alias("_n"))
    if spread:
        ranked = running(values, keys, ["_v"], {"_upto": "_n"}, "_pos")
    else:
        ranked = values.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("_rank", F.col("_upto") - (F.col("_n") - 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("_p") * F.col("_rank")).alias("_r"), F.sum("_p").alias("_np"), F.sum(F.col("_n") - F.col("_p")).alias("_nn"))
    return sums.select(*keys, F.try_divide(F.col("_r") - F.col("_np") * (F.col("_np") + 1) / 2, (F.col("_np") * F.col("_nn")).cast("double")).alias(name))


def medians(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group of any size: values are counted, counts are totalled over range partitions, and the values that reach over the middle are taken."""
    counts = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = kept(running(counts, keys, ["_v"], {"_upto": "_c"}, "_pos", unique=True))
    whole = ranked.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    holds = lambda i: F.max(F.when((F.col("_upto") > i) & (F.col("_upto") - F.col("_c") <= i), F.col("_v")))
    found = ranked.join(whole, keys).groupBy(*keys).agg(holds(F.floor((F.col("_n") - 1) / 2)).alias("_low"), holds(F.floor(F.col("_n") / 2)).alias("_high"))
    return found.select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias(name))


def window_metrics(pred: DataFrame, keys: list[str], step_s: float) -> DataFrame:
    """Per group: counts, tp, fp, tn, fn, rates, AUC, false alarms an hour; null where a class is missing."""
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    rows = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.count_if(t).alias("n_ictal"),
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(~t & ~p).alias("tn"),
        F.count_if(t & ~p).alias("fn"),
    )
    rows = rows.withColumns(
        {
            "sensitivity": F.try_divide("tp", "n_ictal"),
            "specificity": F.try_divide(F.col("tn"), F.col("n_windows") - F.col("n_ictal")),
            "f1": F.when(F.col("n_ictal") > 0, F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))),
            "fa_per_hour": F.try_divide(F.col("fp").cast("double"), F.col("n_windows") * step_s / 3600.0),
        }
    )
    return rows.join(auc(pred, keys, "y_true", "y_score"), keys)


def summary(per_patient: DataFrame, keys: list[str], metrics: list[str] | None = None) -> DataFrame:
    """Per group and metric: mean, sample std, median and number of patients with a value."""
    names = metrics or METRICS
    long = per_patient.unpivot(keys, names, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.median("value").alias("median"), F.count("value").alias("n_patients"))
