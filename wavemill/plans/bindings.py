"""The driver's tables as the pipeline's: users are patients, their events windows, customers and orders patients and recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FS, WINDOW, STEP = 256.0, 1024, 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored windows: a recording is a third of a user's month, its windows its events in order."""
    part = F.floor((F.dayofmonth("ts") - 1) / 10).cast("int")
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", part.alias("part"))
    line = Window.partitionBy("user_id", "part").orderBy("ts", "event_id")
    return rows.select(
        F.col("user_id").alias("patient"),
        F.col("user_id").cast("string").alias("case"),
        F.concat(F.col("user_id").cast("string"), F.lit("_"), F.col("part").cast("string")).alias("file"),
        (STEP * (F.row_number().over(line) - 1)).cast("long").alias("start_sample"),
        F.col("event_type").isin("error", "signup").cast("int").alias("y_true"),
        F.col("value").alias("y_score"),
        (F.col("value") > 40).cast("int").alias("y_pred"),
        F.col("event_type").alias("kind"),
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recordings of customers: whole seconds from the price, seizure recordings by status."""
    o = table(spark, sf_dir, "orders")
    case = F.concat(F.col("o_custkey").cast("string"), F.lit("c"), (F.col("o_orderkey") % 2).cast("string"))
    return o.select(
        F.col("o_custkey").alias("patient"),
        case.alias("case"),
        F.concat(case, F.lit("_"), F.col("o_orderkey").cast("string")).alias("file"),
        F.floor(F.col("o_totalprice") / 100).cast("double").alias("duration_s"),
        F.when(F.col("o_orderstatus") == "F", "seizure").otherwise("seizure_free").alias("role"),
        F.when(F.col("o_orderpriority").startswith("5"), "missing_channel:P7-O1").alias("bad"),
    )


def windows_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as windows of one channel: patient is vec_id mod 10, label is label below 3."""
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 10).alias("patient"), (F.col("label") < 3).cast("int").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
