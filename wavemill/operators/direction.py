"""Direction of features: within-patient AUC, and its agreement with the other patients."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept, running
from .metrics import auc, medians

#: Patients up to which one task ranks those of a feature.
RANKED_ALONE = 100_000


def feature_auc(long: DataFrame, min_ictal: int = 30) -> DataFrame:
    """From (patient, label, feature, value) to (patient, feature, auc).

    Patients with fewer than ``min_ictal`` ictal windows or no other are left out; a missing value counts as the patient's median of the feature.
    """
    keys = ["patient", "feature"]
    missing = F.col("value").isNull() | F.isnan("value")
    sizes = long.groupBy(*keys).agg(F.count_if(F.col("label") == 1).alias("_p"), F.count(F.lit(1)).alias("_n"), F.count_if(missing).alias("_missing"))
    sizes = kept(sizes.where((F.col("_p") >= min_ictal) & (F.col("_p") < F.col("_n"))).drop("_p", "_n"))
    rows = long.join(sizes, keys)
    holes = sizes.where("_missing > 0")
    if not holes.isEmpty():  # medians of those groups only
        middle = medians(long.join(holes, keys, "left_semi"), keys, "value", "_median")
        rows = rows.join(middle, keys, "left").withColumn("value", F.when(missing, F.col("_median")).otherwise(F.col("value")))
    return auc(rows, keys, "label", "value")


def consensus(aucs: DataFrame) -> DataFrame:
    """(patient, feature, auc, consensus, n_others): the median of the other patients' AUCs.

    It follows from a patient's rank within the feature and the middle order
    statistics, so patients never meet in pairs; features with more than ``RANKED_ALONE``
    of them are ranked over range partitions.
    """
    aucs = kept(aucs)
    known = aucs.where("auc is not null").select("patient", "feature", "auc")
    if (known.groupBy("feature").count().agg(F.max("count")).first()[0] or 0) > RANKED_ALONE:
        ranked = kept(running(known, ["feature"], ["auc", "patient"], {}, "_i", unique=True))
    else:
        ranked = known.withColumn("_i", F.row_number().over(Window.partitionBy("feature").orderBy("auc", "patient")) - 1)
    sizes = ranked.groupBy("feature").agg(F.count(F.lit(1)).alias("_n"))
    middle = F.floor(F.col("_n") / 2)
    at = lambda k: F.max(F.when(F.col("_i") == middle + k, F.col("auc")))
    mids = ranked.join(sizes, "feature").where(F.abs(F.col("_i") - middle) <= 1).groupBy("feature").agg(F.first("_n").alias("_n"), at(-1).alias("_l"), at(0).alias("_m"), at(1).alias("_r"))
    mean = lambda a, b: (F.col(a) + F.col(b)) / 2
    odd = F.when(F.col("_i") < middle, mean("_m", "_r")).when(F.col("_i") == middle, mean("_l", "_r")).otherwise(mean("_l", "_m"))
    of_others = F.when(F.col("_n") % 2 == 1, odd).when(F.col("_i") < middle, F.col("_m")).otherwise(F.col("_l"))
    own = ranked.join(mids, "feature").select("patient", "feature", "auc", of_others.alias("consensus"), (F.col("_n") - 1).alias("n_others"))
    of_all = F.when(F.col("_n") % 2 == 1, F.col("_m")).otherwise(mean("_l", "_m"))
    none = aucs.where("auc is null").join(mids, "feature", "left").select("patient", "feature", "auc", of_all.alias("consensus"), F.coalesce("_n", F.lit(0)).alias("n_others"))
    return own.unionByName(none)


def summary(aucs: DataFrame, strong: float = 0.10) -> DataFrame:
    """Per patient: mean |AUC - 0.5|, features that are strong in the median of all other patients, and the share of these with the patient's direction."""
    per = consensus(aucs)
    strong_one = (F.col("n_others") >= 2) & (F.abs(F.col("consensus") - 0.5) >= strong)
    agrees = F.signum(F.col("auc") - 0.5) == F.signum(F.col("consensus") - 0.5)
    return per.groupBy("patient").agg(
        F.avg(F.abs(F.col("auc") - 0.5)).alias("separability"),
        F.count_if(strong_one).alias("n_strong_features"),
        F.avg(F.when(strong_one, agrees.cast("double"))).alias("agreement"),
    )


def strongest(aucs: DataFrame, top: int, flipped: str | None = None) -> DataFrame:
    """Features with the median AUC farthest from 0.5; with ``flipped``, whether that patient's direction is the opposite."""
    rows = aucs.groupBy("feature").agg(F.median("auc").alias("consensus"), *([F.max(F.when(F.col("patient") == flipped, F.col("auc"))).alias("focus")] if flipped is not None else []))
    if flipped is not None:
        rows = rows.withColumn("flipped", F.signum(F.col("focus") - 0.5) == -F.signum(F.col("consensus") - 0.5))
    return rows.orderBy(F.desc(F.round(F.abs(F.col("consensus") - 0.5), 9)), "feature").limit(top)


def against_others(aucs: DataFrame, focus: str, top: int) -> DataFrame:
    """The features with the strongest median AUC of all patients but ``focus``, that patient's AUC, and whether its direction is the opposite."""
    others = consensus(aucs).where(F.col("patient") == focus).select("feature", F.col("auc").alias("focus"), "consensus")
    rows = others.withColumn("flipped", (F.col("focus") - 0.5) * (F.col("consensus") - 0.5) < 0)
    return rows.orderBy(F.desc(F.round(F.abs(F.col("consensus") - 0.5), 9)), "feature").limit(top)


def wide(aucs: DataFrame) -> DataFrame:
    """One row per feature, one column per patient."""
    return aucs.groupBy("feature").pivot("patient").agg(F.first("auc"))


def sanity(long: DataFrame) -> DataFrame:
    """From (window, label, channel, feature, value): mean over channels, then by label, with the change in percent and its direction."""
    per_window = long.groupBy("window", "label", "feature").agg(F.avg("value").alias("v"))
    both = per_window.groupBy("feature").agg(F.avg(F.when(F.col("label") == 0, F.col("v"))).alias("interictal"), F.avg(F.when(F.col("label") == 1, F.col("v"))).alias("ictal"))
    change = F.try_divide(100 * (F.col("ictal") - F.col("interictal")), F.abs("interictal"))
    return both.withColumn("pct_change", change).withColumn("direction", F.when(F.col("ictal") > F.col("interictal"), "up").when(F.col("ictal") < F.col("interictal"), "down").otherwise("same"))


def latest(log: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The last row of each key in order of ``sequence``."""
    return log.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(sequence)))).where("_rn = 1").drop("_rn")
