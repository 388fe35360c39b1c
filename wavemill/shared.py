"""Tables kept between jobs in the folder that driver and executors share, and running totals over a global order."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a session on one machine (tests) gets a temporary folder; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/wavemill/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """A path below this application's part of the shared folder that nothing else uses."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: whatever follows reads the files, also after executors
    were lost.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from ``kept`` that nothing will read any more."""
    for t in tables:
        if path := getattr(t, "_kept_at", None):
            _delete(t.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has kept; to be called when its results are written."""
    _delete(spark, _own_folder(spark))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def running(df: DataFrame, group: list[str], order: list[str], totals: dict[str, str], rank: str, unique: bool = False) -> DataFrame:
    """Add running totals and a rank within groups of any size.

    ``totals`` maps the name of a new column to the numeric column that it adds
    up (up to and including the row); ``rank`` names the 0-based position. Rows
    are dealt by range over ``group + order``, so that a group of a third of all
    rows is spread over many tasks; each range is totalled alone and then moved
    by what lies before it. Of these offsets at most one per range differs from
    zero (a range starts inside at most one group), so the broadcast table has
    no more rows than there are ranges. Rows equal in all of ``order`` are
    interchangeable; they get consecutive positions. With ``unique`` the caller
    says that there are none, so that a map task that is run again after a shuffle deals
    every row to the same range as before; without it ``df`` should be a scan.
    """
    n = partitions(df.sparkSession)
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order, "_tie"]]
    dealt = kept(df.withColumn("_tie", F.lit(0).cast("long") if unique else F.monotonically_increasing_id()).repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()))
    per_range = dealt.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{new}") for new, c in totals.items()])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.col("_range").alias("_at"),
        F.sum("_n").over(before).alias("_n0"),
        *[F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_o_{new}") for new in totals],
    ).where("_n0 > 0")
    upto = Window.partitionBy(*group, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in [*order, "_tie"]]).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumns({"_pos": F.row_number().over(upto).cast("long") - 1} | {f"_c_{new}": F.sum(c).over(upto) for new, c in totals.items()})
    on = reduce(lambda a, b: a & b, [same(F.col(c), F.col(f"_g{i}")) for i, c in enumerate(group)], F.col("_range") == F.col("_at"))
    joined = local.join(F.broadcast(offsets), on, "left")
    return joined.select(
        *df.columns,
        (F.col("_pos") + F.coalesce(F.col("_n0"), F.lit(0))).alias(rank),
        *[(F.coalesce(F.col(f"_c_{new}"), F.lit(0)) + F.coalesce(F.col(f"_o_{new}"), F.lit(0))).alias(new) for new in totals],
    )
