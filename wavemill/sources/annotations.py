"""Seizure annotations from summary texts: one text per case, cut and parsed by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cohort import patient_of

# How a summary names a file, its clock times, its seizures and their bounds.
FILE = r"(?m)^File Name:\s*"
COUNT = r"Number of Seizures in File:\s*(\d+)"
START = r"Seizure(?: \d+)? Start Time:\s*(\d+) seconds"
END = r"Seizure(?: \d+)? End Time:\s*(\d+) seconds"
FILE_START, FILE_END = r"File Start Time:\s*(\d+:\d+:\d+)", r"File End Time:\s*(\d+:\d+:\d+)"


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, case, text) of all ``*-summary.txt`` below a folder."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*-summary.txt").text(root, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("_metadata.file_name", r"(.*)-summary\.txt", 1).alias("case"), F.col("value").alias("text"))


def clock_seconds(clock: Column) -> Column:
    """H:M:S as seconds; hours may be above 23. Null if it is no clock."""
    part = lambda i: F.nullif(F.regexp_extract(clock, r"(\d+):(\d+):(\d+)", i), F.lit("")).cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def blocks(texts: DataFrame) -> DataFrame:
    """(case, file, block, duration_s, declared, seizures) per file of every summary; times pair up to the shorter list."""
    cut = texts.select("case", F.posexplode(F.split("text", FILE)).alias("block", "body")).where("block > 0")
    starts, ends = F.regexp_extract_all("body", F.lit(START), F.lit(1)), F.regexp_extract_all("body", F.lit(END), F.lit(1))
    rows = cut.withColumns({"_s": starts, "_e": ends, "file": F.trim(F.regexp_extract("body", r"^([^\n\r]*)", 1))})
    n = F.least(F.size("_s"), F.size("_e"))
    pairs = F.arrays_zip(F.slice("_s", F.lit(1), n).alias("s"), F.slice("_e", F.lit(1), n).alias("e"))
    first, last = clock_seconds(F.regexp_extract("body", FILE_START, 1)), clock_seconds(F.regexp_extract("body", FILE_END, 1))
    duration = last - first + F.when(last < first, 86400).otherwise(0)
    declared = F.nullif(F.regexp_extract("body", COUNT, 1), F.lit("")).cast("int")
    return rows.select("case", "file", "block", duration.cast("double").alias("duration_s"), declared.alias("declared"), F.size("_s").alias("n_starts"), F.size("_e").alias("n_ends"), pairs.alias("seizures"))


def build(parsed: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """The annotations table; a seizure that does not end after its start is dropped."""
    rows = parsed.select("case", "file", "block", F.explode("seizures").alias("z")).select("case", "file", "block", F.col("z.s").cast("double").alias("seizure_start_s"), F.col("z.e").cast("double").alias("seizure_end_s"))
    line = Window.partitionBy("case", "file", "block").orderBy("seizure_start_s", "seizure_end_s")
    rows = rows.where("seizure_end_s > seizure_start_s").withColumn("seizure_idx", F.row_number().over(line) - 1)
    return rows.select(patient_of(F.col("case"), mapping or {}).alias("patient"), "case", "file", "seizure_idx", "seizure_start_s", "seizure_end_s")


def problems(parsed: DataFrame) -> DataFrame:
    """Files whose declared number of seizures is not the parsed one, or whose starts and ends do not pair."""
    n = F.size("seizures")
    return parsed.where((F.col("declared").isNotNull() & (F.col("declared") != n)) | (F.col("n_starts") != F.col("n_ends"))).select("case", "file", "declared", n.alias("parsed"), "n_starts", "n_ends")


def durations(parsed: DataFrame) -> DataFrame:
    """(file, duration_s): the last mention of a file in its summary wins."""
    return parsed.groupBy("file").agg(F.max_by("duration_s", F.struct("case", "block")).alias("duration_s"))
