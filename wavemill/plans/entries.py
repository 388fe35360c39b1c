"""The pipeline's entries: each reads tables below one root, writes the next, and can be run alone.

``root`` holds ``raw`` (EDF files in a folder per case, with RECORDS and
summaries) and gets ``tables`` (annotations, index), ``signals``, ``adaptive``,
``windows``, ``features``, ``predictions``, ``reports`` and ``logs``.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config, schemas
from ..functions import adaptive as adaptive_filters
from ..functions import features as feature_table
from ..functions import filters
from ..operators import calibration, cohort, compare, direction, events, leakage, metrics, windows
from ..shared import discard, kept
from ..sources import annotations, edf, tables
from . import loso


#: Seconds of a recording that a row of signals holds.
CHUNK_S = 600
#: In which order an adaptive filter takes the chunks of a case.
ORDER = ("file_order", "chunk_idx", "start_sample")


def _only(df: DataFrame, patients: list[str] | None) -> DataFrame:
    return df.where(F.col("patient").isin(patients)) if patients else df


def _check_patients(spark: SparkSession, known: DataFrame, patients: list[str] | None) -> None:
    if patients:
        asked = spark.createDataFrame([(p,) for p in patients], "patient string")
        leakage.require_none(leakage.unknown_patients(asked, known), "unknown patients")


def _signals(spark: SparkSession, root: str) -> DataFrame:
    """Filtered chunks, without the channels of which one failed."""
    rows = spark.read.parquet(f"{root}/signals")
    return rows.join(rows.where("error is not null").select("case", "file", "channel"), ["case", "file", "channel"], "left_anti")


def index(spark: SparkSession, root: str, cfg: dict, patients: list[str] | None = None, mapping: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """Annotations and the index of recordings with the chosen cohort; recordings whose header cannot be used are replaced by others.

    ``mapping`` says which cases are other patients'; without it the settings do.
    """
    edf.register(spark)
    mapping = cfg["dataset"].get("patient_map") if mapping is None else mapping
    fs, cap = float(cfg["dataset"]["fs"]), float(cfg["dataset"]["max_seizure_free_hours_per_patient"])
    parsed = annotations.blocks(annotations.read_texts(spark, f"{root}/raw"))
    if strict:
        leakage.require_none(annotations.problems(parsed), "declared and parsed seizures differ")
    notes = annotations.build(parsed, mapping)
    notes.write.mode("overwrite").parquet(f"{root}/tables/annotations")
    headers = spark.read.format("edf").option("mode", "header").load(f"{root}/raw")
    usable = cohort.usable(headers, cfg["dataset"]["channels"], fs, config.aliases(cfg))
    whole = cohort.file_index(tables.read_records(spark, f"{root}/raw/RECORDS"), notes, annotations.durations(parsed), headers.where("error is null"), fs, mapping)
    _check_patients(spark, whole, patients)
    check = lambda chosen: chosen.join(usable.where("not ok"), "file").select("file", "reason")
    chosen = cohort.fixed_point(_only(whole, patients), cap, check)
    columns = [c.split()[0] for c in schemas.FILE_INDEX.split(", ")]
    tables.upsert_patients(spark, chosen.select(*columns), f"{root}/tables/index")
    return tables.current(spark, f"{root}/tables/index")


def preprocess(spark: SparkSession, root: str, cfg: dict, patients: list[str] | None = None, overwrite: bool = False) -> DataFrame:
    """Filtered channels of the included recordings in chunks, and a status row per recording in the log.

    Recordings whose channels were written before, all of them and as long as the index says, are skipped.
    """
    edf.register(spark)
    fs, names = float(cfg["dataset"]["fs"]), cfg["dataset"]["channels"]
    path = f"{root}/signals"
    chosen = tables.current(spark, f"{root}/tables/index").where("include")
    _check_patients(spark, chosen, patients)
    chosen = _only(chosen, patients).select("case", "file", "n_samples")
    old = None if overwrite else tables.written(spark, path)
    work = kept(chosen if old is None else tables.unwritten(chosen, tables.complete(old, len(names)), ["case", "file"]))
    source = spark.read.format("edf").option("unusable", "skip").option("chunk_s", CHUNK_S).option("channels", ",".join(names)).option("aliases", ",".join(f"{c}={o}" for c, others in config.aliases(cfg).items() for o in others))
    raw = source.load(f"{root}/raw").join(work.select("case", "file"), ["case", "file"], "left_semi")
    # a chunk is as long as the source's default of ten minutes, or as one data record; the last one may be shorter
    done = filters.preprocess(raw, fs, cfg["filter"], least=round(CHUNK_S / 2 * fs))
    tables.write_by_case(done, path, ("case", "file"))
    have = filters.channels(spark.read.parquet(path)).join(chosen.select("case", "file"), ["case", "file"], "left_semi")
    sizes = have.groupBy("case", "file").agg(F.max("n_samples").alias("_n"), F.count_if(F.col("status") == "flat").cast("int").alias("flat_channels"))
    wrong = tables.incomplete(have, chosen, len(names)).withColumnRenamed("reason", "error")
    log = chosen.join(work.select("case", "file", F.lit(True).alias("_new")), ["case", "file"], "left").join(sizes, ["case", "file"], "left").join(wrong, ["case", "file"], "left")
    status = F.when(F.col("_n").isNull() | F.col("error").isNotNull(), "failed").when(F.col("_new"), "success").otherwise("skipped_existing")
    log = kept(log.select(F.lit(uuid.uuid4().hex[:12]).alias("run_id"), "file", "case", status.alias("status"), F.col("_n").alias("n_samples"), (F.col("_n") / fs).alias("eeg_seconds"), F.lit(None).cast("double").alias("elapsed_s"), "flat_channels", "error"))
    tables.append_log(log, f"{root}/logs/preprocess")
    return log


def adapt(spark: SparkSession, root: str, cfg: dict, method: str | None = None, params: dict | None = None, warm_start_s: float | None = None, patients: list[str] | None = None, overwrite: bool = False) -> DataFrame:
    """Signals through an adaptive filter, in order of each case's recordings; written below the setting's name, with the state after each.

    The first recordings of a case that an earlier run has filtered whole are skipped, and the
    chain goes on from the state after them; all later ones are filtered again, as they depend on those before.
    """
    method = method or cfg["adaptive"]["method"]
    params = config.method_params(method, params)
    warm = float(cfg["adaptive"]["warm_start_s"] if warm_start_s is None else warm_start_s)
    setting = config.tag(method, params, warm)
    fs, path = float(cfg["dataset"]["fs"]), f"{root}/adaptive/{setting}"
    chosen = _only(tables.current(spark, f"{root}/tables/index").where("include"), patients).select("patient", "case", "file", "n_samples", cohort.suffix(F.col("file"), 10**9).alias("file_order"))
    old = None if overwrite else tables.written(spark, path)
    if old is None:
        work, states = kept(chosen.select("*", F.lit(False).alias("had"))), None
    else:
        whole = tables.complete(old.where("status = 'success'"), len(cfg["dataset"]["channels"])).select("case", "file", F.col("n_samples").alias("_n"))
        line = Window.partitionBy("case").orderBy("file_order", "file").rowsBetween(Window.unboundedPreceding, 0)
        marked = chosen.join(whole, ["case", "file"], "left").withColumn("had", F.coalesce(F.col("_n") == F.col("n_samples"), F.lit(False)))
        marked = kept(marked.withColumn("_skip", F.min("had").over(line)).drop("_n"))
        work = marked.where("not _skip").drop("_skip")
        states = kept(adaptive_filters.states(old.join(marked.where("_skip").select("case", "file"), ["case", "file"], "left_semi"), method, params, warm, ORDER))
    signals = _signals(spark, root).drop("n_samples", "error").join(work, ["case", "file"])
    out = adaptive_filters.run(signals, method, params, fs, warm, ORDER, states)
    columns = ["case", "file", "channel", *ORDER, F.coalesce(F.size("samples"), F.lit(0)).alias("n_samples"), "samples", "status", "rms_in", "rms_out", "error", *adaptive_filters.PARTS]
    tables.write_by_case(out.select(*columns), path, ("case", "file"))
    done = spark.read.parquet(path).withColumnRenamed("n_samples", "_size").drop("file_order").join(chosen, ["case", "file"])
    worst = F.max(F.when(F.col("status") == "failed", 2).when(F.col("status") == "not_run", 1).otherwise(0))
    rms = lambda c: F.sqrt(F.try_divide(F.sum(F.col("_size") * F.col(c) * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("_size"))).cast("double"))).alias(c)
    of_channel = done.groupBy("patient", "case", "file", "channel").agg(worst.alias("w"), F.sum("_size").cast("long").alias("n_samples"), rms("rms_in"), rms("rms_out"), F.max("error").alias("error"))
    log = of_channel.groupBy("patient", "case", "file").agg(F.max("w").alias("w"), F.max("n_samples").alias("n_samples"), F.avg("rms_in").alias("rms_in"), F.avg("rms_out").alias("rms_out"), F.max("error").alias("error"))
    log = log.join(work.select("case", "file", "had"), ["case", "file"], "left")
    fine = F.when(F.col("had").isNull(), "skipped_existing").when(F.col("had"), "recomputed_downstream").otherwise("success")
    status = F.when(F.col("w") == 2, "failed").when(F.col("w") == 1, "not_run").otherwise(fine)
    log = kept(log.select(F.lit(uuid.uuid4().hex[:12]).alias("run_id"), F.lit(setting).alias("setting"), "patient", "case", "file", status.alias("status"), "n_samples", (F.col("n_samples") / fs).alias("eeg_seconds"), "rms_in", "rms_out", F.lit(None).cast("double").alias("elapsed_s"), "error"))
    tables.append_log(log, f"{root}/logs/adaptive")
    return log


def make_windows(spark: SparkSession, root: str, cfg: dict, patients: list[str] | None = None) -> DataFrame:
    """Labelled windows of the included recordings; returns counts per patient."""
    fs = float(cfg["dataset"]["fs"])
    length, step = config.window_samples(cfg)
    chosen = _only(tables.current(spark, f"{root}/tables/index").where("include"), patients).select("patient", "case", "file")
    sizes = filters.channels(_signals(spark, root)).groupBy("case", "file").agg(F.max("n_samples").alias("n_samples"))
    seizures = windows.sample_bounds(spark.read.parquet(f"{root}/tables/annotations"), fs)
    made = windows.labelled(chosen.join(sizes, ["case", "file"]), seizures, length, step, fs, bool(cfg["segmentation"]["drop_boundary"]))
    tables.write_by_case(made.select("patient", "case", "file", "start_sample", "t_start_s", "label"), f"{root}/windows")
    return windows.counts(spark.read.parquet(f"{root}/windows"))


def extract_features(spark: SparkSession, root: str, cfg: dict, patients: list[str] | None = None, source: str = "signals") -> DataFrame:
    """The wide feature table of all windows; returns how many values were replaced."""
    fs, nonlinear, channels = float(cfg["dataset"]["fs"]), bool(cfg["features"]["nonlinear"]), cfg["dataset"]["channels"]
    length, step = config.window_samples(cfg)
    keys = ["patient", "case", "file", "start_sample", "t_start_s", "label"]
    wanted = _only(spark.read.parquet(f"{root}/windows"), patients)
    signals = _signals(spark, root) if source == "signals" else spark.read.parquet(f"{root}/{source}")
    cut = windows.chunk_slices(signals, length, step, fs, least=round(CHUNK_S / 2 * fs)).drop("t_start_s")
    rows = cut.join(wanted, ["case", "file", "start_sample"]).select(*keys, "channel", "x")
    long = feature_table.with_features(rows, fs, nonlinear=nonlinear)
    long, seen = feature_table.counted(long)
    tables.write_by_case(long, f"{root}/features_long")
    back = _only(spark.read.parquet(f"{root}/features_long"), patients)
    tables.write_by_case(feature_table.wide(back, keys, channels, nonlinear), f"{root}/features")
    share = feature_table.share_non_finite(seen.get["replaced"], seen.get["n"], len(config.feature_names(nonlinear)))
    return spark.createDataFrame([tuple(share.values())], "replaced long, values long, warn boolean")


def baseline(spark: SparkSession, root: str, cfg: dict, arms: list[str] | None = None, models: list[str] | None = None, patients: list[str] | None = None, most_patients: int | None = None) -> DataFrame:
    """Held-out predictions of every arm and model; returns the window metrics per patient.

    ``patients``, and of these the first ``most_patients`` in order, are all that
    there is: others are neither held out nor trained on. Models, grids, features and
    training rows follow the settings; what each fold chose is in ``reports/chosen``.
    """
    rows = _only(spark.read.parquet(f"{root}/features"), patients)
    if most_patients is not None:
        rows = rows.join(rows.select("patient").distinct().orderBy("patient").limit(most_patients), "patient", "left_semi")
    names = [c for c in rows.columns if c.startswith("f_")]
    leakage.require_none(leakage.split_cases(rows), "cases of several patients")
    leakage.require_none(leakage.non_finite(rows, names), "features that are not finite")
    window_s, overlap = float(cfg["segmentation"]["window_s"]), float(cfg["segmentation"]["overlap"])
    n = calibration.calibration_length(cfg["evaluation"]["calibration"]["minutes"], window_s, overlap)
    seed = int(cfg["project"]["seed"])
    settings = []
    for arm in arms or cfg["evaluation"]["arms"]:
        table = kept(calibration.arm(rows, names, arm, n, int(cfg["evaluation"]["calibration"]["min_windows"])))
        held = loso.held_out(table)
        for kind in models or cfg["evaluation"]["models"]:
            chosen: list = []
            pred = kept(loso.predict(table, names, kind, held, seed, chosen=chosen, **config.learning(cfg, kind)))
            leakage.require_none(leakage.scored_calibration(pred, table.where("is_calibration")), "scored calibration windows")
            tables.write_predictions(pred.withColumns({"arm": F.lit(arm), "model": F.lit(kind)}), f"{root}/predictions")
            settings += [(arm, kind, str(p), str(q)) for p, q in chosen]
        discard(table)
    tables.write_report(spark.createDataFrame(settings, "arm string, model string, patient string, setting string"), f"{root}/reports/chosen")
    return metrics.window_metrics(spark.read.parquet(f"{root}/predictions"), ["arm", "model", "patient"], window_s * (1 - overlap))


def report(spark: SparkSession, root: str, cfg: dict, reference: str = "raw", dev: list[str] = (), tag: str = "", **alarm_options) -> dict[str, DataFrame]:
    """Summary, event report, and comparison of arms, each also written as one CSV; ``tag`` ends the name of the events' one."""
    pred = spark.read.parquet(f"{root}/predictions")
    fs, window_s = float(cfg["dataset"]["fs"]), float(cfg["segmentation"]["window_s"])
    step_s = window_s * (1 - float(cfg["segmentation"]["overlap"]))
    per_patient = metrics.window_metrics(pred, ["arm", "model", "patient"], step_s)
    by_event, _, _ = events.tables(pred, ["arm", "model", "patient"], fs, window_s, step_s, **alarm_options)
    out = {
        "per_patient": per_patient,
        "summary": metrics.summary(per_patient, ["arm", "model"]),
        "events": events.report(by_event),
        "arms": compare.arms(per_patient, reference, list(dev), ["sensitivity", "specificity", "f1", "auc"]),
        "patients_by_arm": per_patient.groupBy("model", "patient").pivot("arm").agg(F.first("auc")),
    }
    for name, df in out.items():
        tables.write_report(df, f"{root}/reports/{name}{tag if name == 'events' else ''}")
    return out


def feature_directions(spark: SparkSession, root: str, min_ictal: int = 30, top: int = 12, focus: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Agreement of each patient's feature directions with the others', and the ``top`` features with the strongest ones; both also written as CSV.

    With ``focus`` the strongest are those in the median of all other patients, beside what this patient does with them.
    """
    rows = spark.read.parquet(f"{root}/features")
    names = [c for c in rows.columns if c.startswith("f_")]
    long = rows.select("patient", "label", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["patient", "label"], names, "feature", "value")
    aucs = kept(direction.feature_auc(long, min_ictal))
    if focus is not None:
        leakage.require_none(spark.createDataFrame([(focus,)], "patient string").join(aucs.select("patient"), "patient", "left_anti"), "patients with too few ictal windows or unknown ones")
    out = direction.summary(aucs), direction.strongest(aucs, top) if focus is None else direction.against_others(aucs, focus, top)
    for name, df in zip(("feature_direction_summary", "feature_direction"), (out[0], direction.wide(aucs)), strict=True):
        tables.write_report(df, f"{root}/reports/{name}")
    return out


def feature_sanity(spark: SparkSession, root: str, cfg: dict, cases: list[str] | None = None) -> DataFrame:
    """Each feature's mean over channels in ictal and other windows, and its change in percent."""
    rows = spark.read.parquet(f"{root}/features_long")
    rows = rows.where(F.col("case").isin(cases)) if cases else rows
    leakage.require_some(rows.where("label = 1"), "ictal windows")
    names = config.feature_names(bool(cfg["features"]["nonlinear"]))
    window = F.concat_ws("|", "case", "file", F.col("start_sample").cast("string")).alias("window")
    long = rows.select(window, "label", "channel", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["window", "label", "channel"], names, "feature", "value")
    return direction.sanity(long)


def adaptive_ratios(spark: SparkSession, root: str, cases: list[str] | None = None) -> DataFrame:
    """Output over input RMS of the last run of each setting and recording, a column per setting."""
    log = spark.read.parquet(f"{root}/logs/adaptive").withColumn("at", F.monotonically_increasing_id())
    log = log.where(F.col("case").isin(cases)) if cases else log
    last = direction.latest(log, ["setting", "file"], "at")
    return last.groupBy("file").pivot("setting").agg(F.first(F.try_divide("rms_out", "rms_in")))


def check_contract(spark: SparkSession, root: str) -> DataFrame:
    """(table, problem) of the written tables against their types."""
    found = [(t, p) for t, schema in (("tables/annotations", schemas.ANNOTATIONS), ("tables/index", schemas.FILE_INDEX), ("windows", schemas.WINDOWS)) for p in schemas.problems(tables.current(spark, f"{root}/{t}") if t == "tables/index" else spark.read.parquet(f"{root}/{t}"), schema)]
    return spark.createDataFrame(found, "table string, problem string")


def shuffle_checks(spark: SparkSession, root: str, cfg: dict, kinds: list[str] = ("svm", "rf"), n_test: int = 3, seeds: list[int] = (0,)) -> DataFrame:
    """Mean AUC with permuted training labels for each model and seed, which must be near chance; appended to the log of such runs."""
    rows = spark.read.parquet(f"{root}/features")
    names = [c for c in rows.columns if c.startswith("f_")]
    people = rows.select("patient").distinct().count()
    run = F.lit(uuid.uuid4().hex[:12])
    done = []
    for kind, seed in product(kinds, seeds):
        got = loso.shuffle_check((rows, names), kind, n_test, seed, **config.learning(cfg, kind))
        mean = got.agg(F.max("mean_auc").alias("auc"), F.coalesce(F.bool_or("passes"), F.lit(False)).alias("within_band"))
        done.append(mean.select(run.alias("run_id"), F.current_timestamp().alias("at"), F.lit(kind).alias("model"), F.lit(seed).alias("seed"), F.lit(min(n_test, people)).alias("n_test_patients"), F.lit(people).alias("n_patients_available"), F.lit(cfg["evaluation"]["tuning"]["mode"]).alias("tuning_mode"), F.round("auc", 4).alias("auc"), "within_band"))
    log = kept(reduce(DataFrame.unionByName, done))
    tables.append_log(log, f"{root}/logs/label_shuffle")
    return log
