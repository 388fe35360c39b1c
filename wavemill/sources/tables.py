"""Readers and writers of the pipeline's tables."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cohort import replace_patients


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(case, file) of a RECORDS list of ``case/file`` lines; blank lines are skipped."""
    line = F.trim("value")
    return spark.read.text(path).where(F.length(line) > 0).select(F.regexp_extract(line, r"^(.*)/[^/]*$", 1).alias("case"), F.regexp_extract(line, r"([^/]*)$", 1).alias("file"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_per_patient(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Tables ``per_patient_<arm>__<model>.csv`` of a folder with arm and model as columns; the first double underscore divides them."""
    rows = spark.read.schema(schema).option("header", True).option("pathGlobFilter", "per_patient_*__*.csv").csv(folder)
    name = F.col("_metadata.file_name")
    part = lambda i: F.regexp_extract(name, r"^per_patient_(.*?)__(.*)\.csv$", i)
    return rows.select("*", part(1).alias("arm"), part(2).alias("model"))


def write_by_case(df: DataFrame, path: str, by: tuple[str, ...] = ("case",)) -> None:
    """A folder per case (or case and file); only those in ``df`` are replaced, and only when the job commits."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def written(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that an earlier run may have written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def complete(signals: DataFrame, n_channels: int) -> DataFrame:
    """(case, file, n_samples) of the recordings that have all channels, of one length."""
    known = "n_samples" in signals.columns  # then samples need not be read
    lengths = signals.where("error is null" if known else "samples is not null").groupBy("case", "file", "channel").agg(F.sum("n_samples" if known else F.size("samples")).alias("n"))
    whole = lengths.groupBy("case", "file").agg(F.count(F.lit(1)).alias("channels"), F.min("n").alias("low"), F.max("n").alias("n_samples"))
    return whole.where((F.col("channels") == n_channels) & (F.col("low") == F.col("n_samples"))).select("case", "file", "n_samples")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("arm", "model").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small table (a row per patient or summary) as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _pointer(spark: SparkSession, path: str):
    """Hadoop's file context of a table's folder, and the file in it that names the version that counts."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    where = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where)
    return hadoop.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()), hadoop.Path(where, "_current")


def version(spark: SparkSession, path: str) -> str | None:
    """The folder of a replaceable table that counts; None before the first one."""
    files, pointer = _pointer(spark, path)
    if not files.util().exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return f"{path.rstrip('/')}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``replace`` has written, as of now: later replacements do not touch what this reads."""
    found = version(spark, path)
    if found is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(found)


def replace(df: DataFrame, path: str) -> None:
    """Write a table into a folder of its own, then let the pointer name it: renaming the pointer is one step.

    Whoever reads in between, or after a run that stopped anywhere, sees the whole old
    table or the whole new one. The version before the new one stays for those who still read it; older
    ones go.
    """
    spark = df.sparkSession
    before = (version(spark, path) or "").rsplit("/", 1)[-1]
    name = f"version-{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path.rstrip('/')}/{name}")
    _swap(spark, path, name)
    files, pointer = _pointer(spark, path)
    names = [f.getPath().getName() for f in files.util().listStatus(pointer.getParent())]
    for gone in (v for v in names if v.startswith("version-") and v < before):  # names are in order of time
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(pointer.getParent(), gone), True)


def _swap(spark: SparkSession, path: str, name: str) -> None:
    files, pointer = _pointer(spark, path)
    hadoop, gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
    flag = hadoop.CreateFlag
    fresh = hadoop.Path(pointer.getParent(), f"_current-{uuid.uuid4().hex}")
    stream = files.create(fresh, spark._jvm.java.util.EnumSet.of(flag.CREATE, flag.OVERWRITE), gateway.new_array(getattr(hadoop, "Options$CreateOpts"), 0))
    stream.write(name.encode())
    stream.close()
    rename = getattr(hadoop, "Options$Rename")
    over = gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    files.rename(fresh, pointer, over)


def upsert_patients(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Replace the patients of ``new`` in a table, in one step (``replace``)."""
    whole = new if version(spark, path) is None else replace_patients(current(spark, path).select(new.columns), new)
    replace(whole.orderBy("patient", "file_order"), path)


def unwritten(work: DataFrame, done: DataFrame, keys: list[str], n: str = "n_samples") -> DataFrame:
    """Work that has no output yet, or one of another length."""
    return work.join(done.select(*keys, F.col(n).alias("_n")), keys, "left").where(F.col("_n").isNull() | (F.col("_n") != F.col(n))).drop("_n")


def incomplete(channels: DataFrame, index: DataFrame, n_channels: int) -> DataFrame:
    """(case, file, reason) of recordings whose channels (case, file, channel, n_samples, status) failed, are missing, or are not of the length in the index."""
    gap = F.abs(F.col("n_samples") - F.col("_n"))
    reason = F.when(F.col("status") == "failed", F.concat_ws(": ", "channel", "error")).when(F.col("n_samples") == 0, "empty").when(gap == 1, "off_by_one").when(gap > 1, "length")
    rows = channels.join(index.select("case", "file", F.col("n_samples").alias("_n")), ["case", "file"])
    found = rows.groupBy("case", "file").agg(F.min(reason).alias("reason"), F.count(F.lit(1)).alias("n"))
    return found.select("case", "file", F.coalesce("reason", F.when(F.col("n") < n_channels, "missing_channels")).alias("reason")).where("reason is not null")


def invalid(signals: DataFrame, index: DataFrame) -> DataFrame:
    """(case, file, channel, reason) of outputs that are empty, not finite, or not of the length in the index."""
    rows = signals.join(index.select("file", F.col("n_samples").alias("_n")), "file", "left")
    size = F.size("samples")
    reason = (
        F.when(F.col("samples").isNull() | (size == 0), "empty")
        .when(F.exists("samples", lambda v: F.isnan(v) | (F.abs(v) == float("inf"))), "non_finite")
        .when(F.abs(size - F.col("_n")) == 1, "off_by_one")
        .when(size != F.col("_n"), "length")
    )
    return rows.select("case", "file", "channel", reason.alias("reason")).where("reason is not null")
