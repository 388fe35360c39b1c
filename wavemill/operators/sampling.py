"""Proportional samples of each patient's windows, without a driver-side draw.

How many rows a patient gives is arithmetic over one row per patient; which rows
these are follows from a seeded hash of their keys, ranked within the patient.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept, running


def allocation(counts: DataFrame, target: Column, floor: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """From (patient, n) to (patient, n, alloc): shares of ``target`` rounded down, at least ``floor``, the rest by largest fraction (ties by patient).

    Totals are groupings; what a patient's fraction ranks is found over range
    partitions, so any number of patients may share one target. With ``by`` there is a target for each
    of its groups (as the folds of an evaluation), which are ranked side by side.
    """
    by = list(by)
    share = lambda rows: rows.withColumn("_raw", F.coalesce(F.try_divide("n", "_total"), F.lit(0.0)) * F.col("_target")).withColumn("_base", F.greatest(F.floor("_raw"), F.least(F.lit(floor), F.col("n"))) if floor else F.floor("_raw"))
    goal = F.least(F.greatest(target.cast("long"), F.lit(0)), F.col("_total")).alias("_target")
    last = ["_room", "_behind", "patient"]
    if by:
        everyone = Window.partitionBy(*by)
        rows = share(counts.withColumn("_total", F.sum("n").over(everyone)).select("*", goal)).withColumn("_short", F.col("_target") - F.sum("_base").over(everyone))
        rows = rows.withColumns({"_behind": F.col("_base") - F.col("_raw"), "_room": F.col("n") > F.col("_base")})
        placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_room").orderBy(*last)).cast("long") - 1)
    else:
        total = counts.agg(F.sum("n").alias("_total"))  # a single row, as is what is short
        rows = share(counts.crossJoin(F.broadcast(total)).select("*", goal)).withColumns({"_behind": F.col("_base") - F.col("_raw"), "_room": F.col("n") > F.col("_base")})
        rows = running(rows.select("patient", "n", "_total", "_target", "_base", "_behind", "_room"), ["_room"], last[1:], {}, "_place", unique=True)
        placed = rows.crossJoin(F.broadcast(rows.agg((F.max("_target") - F.sum("_base")).alias("_short"))))
    extra = F.when(F.col("_room") & (F.col("_place") < F.col("_short")), 1).otherwise(0)
    alloc = F.when(F.col("_target") >= F.col("_total"), F.col("n")).otherwise(F.least(F.col("_base") + extra, F.col("n")))
    return placed.select(*by, "patient", "n", alloc.cast("long").alias("alloc"))


def seeded(seed: int, keys: list[str]) -> Column:
    """Pseudo-random order of rows that any engine with MD5 can repeat."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def per_patient(pool: DataFrame, target: Column, seed: int, keys: list[str], floor: int = 0) -> DataFrame:
    """About ``target`` rows of ``pool`` without replacement, allocated over patients."""
    give = allocation(pool.groupBy("patient").agg(F.count(F.lit(1)).alias("n")), target, floor).select("patient", "alloc")
    ranked = pool.join(give, "patient").withColumn("_rn", F.row_number().over(Window.partitionBy("patient").orderBy(seeded(seed, keys), *keys)))
    return ranked.where(F.col("_rn") <= F.col("alloc")).select(*pool.columns)


def training(rows: DataFrame, seed: int, keys: list[str], ratio: float = 5, most: int = 30_000) -> DataFrame:
    """Balanced training rows: all ictal ones and ``ratio`` times as many interictal; both scaled down beyond ``most``, but never a patient's last ictal row."""
    ictal, rest = rows.where("label = 1"), rows.where("label = 0")
    n_ictal, n_rest = (rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0))).first()
    if not n_ictal:
        return rows
    n_rest = min(round(n_ictal * ratio), n_rest)
    rest = per_patient(rest, F.lit(n_rest), seed, keys)
    if (total := n_ictal + n_rest) > most:
        scale = most / total
        ictal = per_patient(ictal, F.lit(max(1, round(n_ictal * scale))), seed, keys, floor=1)
        rest = per_patient(rest, F.lit(max(0, round(n_rest * scale))), seed + 1, keys)
    return ictal.unionByName(rest)


def permuted_labels(rows: DataFrame, seed: int, keys: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Labels dealt anew among all rows (of each group of ``by``): two seeded orders are ranked by range, and equal ranks meet."""
    rows, by = kept(rows), list(by)
    spots = running(rows.withColumn("_h", seeded(seed, keys)), by, ["_h"], {}, "_rn")
    given = running(rows.select(*by, seeded(seed + 1, keys).alias("_h"), F.col("label").alias("_label")), by, ["_h"], {}, "_rn").select(*by, "_rn", "_label")
    return spots.join(given, [*by, "_rn"]).withColumn("label", F.col("_label")).select(*rows.columns)
