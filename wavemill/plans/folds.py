"""Held-out folds as tables: which patients validate together, and the training rows of all folds at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import sampling
from ..shared import kept, running

#: Rows of a patient and class up to which one task ranks them.
RANKED_ALONE = 1_000_000


def group_folds(counts: DataFrame, splits: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """From (patient, n) to (patient, n, split, n_splits): patients by falling number of rows (ties: the larger name first), each into the lightest fold so far.

    There are at most as many folds as patients, so none is empty. A group (of
    ``by``, or everyone) is a row per patient and is dealt in one task: a
    patient's fold depends on all before.
    """
    by = list(by)
    kinds = dict(counts.dtypes)

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "patient"], ascending=False)
        n_splits = min(splits, len(rows))
        load, of = np.zeros(n_splits, np.int64), []
        for n in rows["n"]:
            of.append(int(load.argmin()))
            load[of[-1]] += n
        return rows.assign(split=of, n_splits=n_splits)[[*by, "patient", "n", "split", "n_splits"]]

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], f"patient {kinds['patient']}", f"n {kinds['n']}", "split int", "n_splits int"])
    return counts.select(*by, "patient", "n").groupBy(*by).applyInPandas(deal, schema)


def _ranked(rows: DataFrame, largest: int, seed: int, keys: list[str]) -> DataFrame:
    """``_rank`` of each row in a seeded order of its patient's rows of its class."""
    rows = rows.withColumn("_h", sampling.seeded(seed, keys))
    if largest > RANKED_ALONE:
        return running(rows, ["patient", "label"], ["_h", *keys], {}, "_rank")
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy("patient", "label").orderBy("_h", *keys)).cast("long") - 1)


def training(rows: DataFrame, held: list, seed: int, keys: list[str], ratio: float = 5, most: int | None = 30_000) -> DataFrame:
    """The training rows of every fold: the columns of ``rows`` with ``fold``, the place in ``held`` of the patient that is left out.

    In each fold all ictal rows of the other patients and ``ratio`` times as many
    interictal ones, shared by the patients' numbers of rows; beyond ``most`` both are scaled down, but
    never to a patient's last ictal row. Shares are arithmetic over a row per
    patient and fold; the rows are ranked once, and fold by fold a patient gives
    the first ones of that order. Only rows that a fold takes are copied to it.
    """
    counts = kept(rows.groupBy("patient").agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0")))
    largest = counts.agg(F.max(F.greatest("n1", "n0"))).first()[0] or 0
    who = F.array(*[F.lit(p) for p in held])
    per = counts.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(len(held) - 1)))).where(~F.element_at(who, F.col("fold") + 1).eqNullSafe(F.col("patient")))
    sizes = per.groupBy("fold").agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    asked = F.when(F.col("t1") == 0, F.col("t0")).otherwise(F.least(F.bround(F.col("t1") * float(ratio)).cast("long"), F.col("t0")))
    scale = F.lit(1.0) if most is None else F.when(F.col("t1") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.lit(most) / (F.col("t1") + F.col("asked"))))
    sizes = sizes.withColumn("asked", asked).withColumn("scale", scale)
    per = kept(per.join(sizes, "fold"))
    share = lambda col, target, floor=0: sampling.allocation(per.select("fold", "patient", F.col(col).alias("n"), target.alias("_goal")), F.col("_goal"), floor, ("fold",)).select("fold", "patient", "alloc")
    ictal = share("n1", F.when(F.col("scale") < 1, F.greatest(F.lit(1), F.bround(F.col("t1") * F.col("scale")))).otherwise(F.col("t1")), 1)
    rest = share("n0", F.col("asked"))
    again = rest.join(sizes, "fold")
    rest = sampling.allocation(again.select("fold", "patient", F.col("alloc").alias("n"), F.when(F.col("scale") < 1, F.greatest(F.lit(0), F.bround(F.col("asked") * F.col("scale")))).otherwise(F.col("asked")).alias("_goal")), F.col("_goal"), 0, ("fold",)).select("fold", "patient", "alloc")
    give = ictal.withColumn("label", F.lit(1)).unionByName(rest.withColumn("label", F.lit(0))).where("alloc > 0")
    ranked = _ranked(rows.withColumn("label", F.col("label").cast("int")), largest, seed, keys)
    return ranked.join(give, ["patient", "label"]).where(F.col("_rank") < F.col("alloc")).drop("_h", "_rank", "alloc")
