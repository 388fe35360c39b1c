"""Checks against leakage between training and test, each a table of what breaks the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_patients(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.select("patient").intersect(test.select("patient"))


def split_cases(rows: DataFrame) -> DataFrame:
    """Cases that belong to more than one patient."""
    return rows.groupBy("case").agg(F.count_distinct("patient").alias("n_patients")).where("n_patients > 1")


def non_finite(rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n_bad) of the columns that hold null, NaN or infinite values."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return rows.agg(*[F.count_if(bad(c)).alias(c) for c in features]).unpivot([], features, "feature", "n_bad").where("n_bad > 0")


def finite(rows: DataFrame, features: list[str]) -> DataFrame:
    """Values that are null, NaN or infinite become 0."""
    return rows.withColumns({c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(F.col(c)) for c in features})


def scored_calibration(pred: DataFrame, calibration: DataFrame, keys: tuple[str, ...] = ("patient", "case", "file", "start_sample")) -> DataFrame:
    """Predictions for windows that served as calibration."""
    return pred.join(calibration.select(*keys).distinct(), list(keys), "left_semi")


def require_none(found: DataFrame, what: str) -> None:
    if not found.isEmpty():
        raise ValueError(f"{what}: {found.limit(5).collect()}")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def unknown_patients(asked: DataFrame, known: DataFrame) -> DataFrame:
    return asked.select("patient").exceptAll(known.select("patient").distinct())


def require_some(rows: DataFrame, what: str) -> None:
    if not rows.limit(1).count():
        raise ValueError(f"no {what}")
