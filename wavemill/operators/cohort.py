"""Index of recordings and choice of a cohort under a cap of seizure-free hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stem(file: Column) -> Column:
    return F.regexp_replace(file, r"\.[^./]*$", "")


def suffix(file: Column, missing: int = 0) -> Column:
    """The number after the last underscore of a recording's name."""
    return F.coalesce(F.nullif(F.regexp_extract(stem(file), r"_(\d+)\D*$", 1), F.lit("")).cast("long"), F.lit(missing))


def patient_of(case: Column, mapping: dict[str, str]) -> Column:
    if not mapping:
        return case
    return F.coalesce(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[case], case)


def file_index(records: DataFrame, annotations: DataFrame, durations: DataFrame, headers: DataFrame | None, fs: float, mapping: dict[str, str] | None = None, default_s: float = 3600.0) -> DataFrame:
    """From (case, file): patient, order, duration (header, else summary, else default), samples, seizures and role."""
    seizures = annotations.groupBy("file").agg(F.count(F.lit(1)).cast("int").alias("n_seizures"))
    rows = records.join(seizures, "file", "left").join(durations.select("file", F.col("duration_s").alias("_summary")), "file", "left")
    rows = rows.join(headers.select("file", F.col("duration_s").alias("_header")), "file", "left") if headers is not None else rows.withColumn("_header", F.lit(None).cast("double"))
    duration = F.coalesce("_header", "_summary", F.lit(float(default_s)))
    rows = rows.withColumns({"patient": patient_of(F.col("case"), mapping or {}), "duration_s": duration, "n_samples": F.bround(duration * float(fs)).cast("long"), "n_seizures": F.coalesce("n_seizures", F.lit(0))})
    rows = rows.withColumn("role", F.when(F.col("n_seizures") > 0, "seizure").otherwise("seizure_free"))
    return ordered(rows).drop("_header", "_summary")


def ordered(rows: DataFrame) -> DataFrame:
    """file_order, from 1 in each patient, by case, number of the recording, name."""
    line = Window.partitionBy("patient").orderBy("case", suffix(F.col("file")), "file")
    return rows.withColumn("file_order", F.row_number().over(line))


def bisection_key(position: Column, n: Column, levels: int = 32) -> Column:
    """Where a position stands when a range is halved again and again, midpoints first: a (level, position) pair to sort by."""
    start = F.struct(F.lit(0).cast("long").alias("lo"), n.cast("long").alias("hi"), F.lit(0).alias("level"), F.lit(False).alias("done"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2)
        deeper = F.struct(F.when(position > mid, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(position > mid, acc["hi"]).otherwise(mid).alias("hi"), (acc["level"] + 1).alias("level"), F.lit(False).alias("done"))
        found = F.struct(acc["lo"], acc["hi"], acc["level"], F.lit(True).alias("done"))
        return F.when(acc["done"], acc).when(position == mid, found).otherwise(deeper)

    level = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, halve, lambda a: a["level"])
    return F.struct(level.alias("level"), position.cast("long").alias("position"))


def select(index: DataFrame, cap_hours: float, unusable: DataFrame | None = None) -> DataFrame:
    """include and exclude_reason by the rules in order: unusable recordings out, patients without a usable seizure recording out,
    seizure recordings in, the first usable recording of each case in, then seizure-free ones in bisection order until the cap is reached."""
    rows = index.drop("include", "exclude_reason")
    rows = rows.join(unusable.select("file", F.col("reason").alias("_bad")), "file", "left") if unusable is not None else rows.withColumn("_bad", F.lit(None).cast("string"))
    ok = F.col("_bad").isNull()
    patient = Window.partitionBy("patient")
    rows = rows.withColumn("_any", F.max(F.when(ok & (F.col("role") == "seizure"), 1).otherwise(0)).over(patient) == 1)
    first = F.row_number().over(Window.partitionBy("patient", "case", ok).orderBy("file_order")) == 1
    rows = rows.withColumn("_first", ok & first)
    sure = ok & ((F.col("role") == "seizure") | F.col("_first"))
    rows = rows.withColumn("_sure", sure).withColumn("_cand", ok & ~sure)
    hours = F.col("duration_s") / 3600.0
    rows = rows.withColumn("_spent", F.sum(F.when(F.col("_sure") & (F.col("role") != "seizure"), hours).otherwise(0.0)).over(patient))
    rows = rows.withColumn("_n", F.sum(F.col("_cand").cast("int")).over(patient))
    rows = rows.withColumn("_pos", F.row_number().over(Window.partitionBy("patient", "_cand").orderBy("file_order")) - 1)
    rows = rows.withColumn("_key", F.when(F.col("_cand"), bisection_key(F.col("_pos"), F.col("_n"))))
    before = Window.partitionBy("patient", "_cand").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_used", F.col("_spent") + F.coalesce(F.sum(F.when(F.col("_cand"), hours)).over(before), F.lit(0.0)))
    include = F.col("_any") & (F.col("_sure") | (F.col("_cand") & (F.col("_used") < cap_hours)))
    reason = F.when(~ok, F.col("_bad")).when(~F.col("_any"), "no_seizure_patient").when(include, "").otherwise("over_cap")
    return rows.withColumns({"include": include, "exclude_reason": reason}).select(*index.drop("include", "exclude_reason").columns, "include", "exclude_reason")


def summary(index: DataFrame, fs: float, n_channels: int = 18) -> DataFrame:
    """Per patient, over included recordings: counts, hours and the size of the signals in GB."""
    hours = F.col("duration_s") / 3600.0
    return index.where("include").groupBy("patient").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("role") == "seizure").alias("seizure_files"),
        F.sum(F.when(F.col("role") == "seizure_free", hours).otherwise(0.0)).alias("seizure_free_hours"),
        F.sum(hours).alias("total_hours"),
        (F.sum(F.col("duration_s")) * fs * n_channels * 4 / 1e9).alias("cache_gb"),
    )


def validate(index: DataFrame) -> DataFrame:
    """Per patient: whether it lost all included recordings, and whether it has no seizure-free one."""
    return index.groupBy("patient").agg((F.count_if("include") == 0).alias("lost"), (F.count_if(F.col("include") & (F.col("role") == "seizure_free")) == 0).alias("no_seizure_free"), F.count_if(~F.col("include")).alias("n_excluded"))


def fixed_point(index: DataFrame, cap_hours: float, check, rounds: int = 5) -> DataFrame:
    """Choose, check the chosen recordings (``check(included) -> (file, reason)`` of the unusable), and choose again until none is new."""
    bad = None
    for _ in range(rounds):
        chosen = select(index, cap_hours, bad)
        found = check(chosen.where("include"))
        new = found if bad is None else found.join(bad, "file", "left_anti")
        if new.isEmpty():
            break
        bad = found if bad is None else bad.unionByName(new)
    return select(index, cap_hours, bad)


def usable(headers: DataFrame, required: list[str], fs: float = 256.0, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(file, ok, reason) of header rows (file, error, sfreq, ch_names): unreadable, wrong rate, or a missing channel."""
    found = resolve_channels(F.col("ch_names"), required, aliases)
    lacking = F.array_compact(F.transform(F.arrays_zip(F.array(*[F.lit(c) for c in required]).alias("want"), found.alias("has")), lambda c: F.when(c["has"].isNull(), c["want"])))
    reason = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("unreadable_edf:"), F.col("error")))
        .when(F.col("sfreq") != fs, F.concat(F.lit("bad_fs:"), F.col("sfreq").cast("string")))
        .when(F.size(lacking) > 0, F.concat(F.lit("missing_channel:"), F.get(lacking, F.lit(0))))
    )
    return headers.select("file", reason.isNull().alias("ok"), reason.alias("reason"))


def names_of(channel: str, aliases: dict[str, list[str]] | None = None) -> list[str]:
    """The names under which a recording may have a channel, the preferred one first: its own, its aliases, and its own with ``-0`` (the first of duplicates)."""
    return list(dict.fromkeys([channel, *(aliases or {}).get(channel, []), f"{channel}-0"]))


def resolve_channels(available: Column, required: list[str], aliases: dict[str, list[str]] | None = None) -> Column:
    """For each required channel the name it has among ``available``, else null."""
    one = lambda c: F.coalesce(*[F.when(F.array_contains(available, t), F.lit(t)) for t in names_of(c, aliases)])
    return F.array(*[one(c) for c in required])


def replace_patients(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with the rows of ``old`` for all other patients."""
    return old.join(new.select("patient").distinct(), "patient", "left_anti").unionByName(new)
