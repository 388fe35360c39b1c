"""Registry of the queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import config
from .functions import adaptive, kernels, time_domain
from .functions import features as feature_table
from .operators import calibration, cohort, compare, direction, events, leakage, metrics, sampling, windows
from .oracles import ORACLES
from .plans import folds, loso, screen
from .plans.bindings import FS, STEP, WINDOW, predictions, recordings, table, windows_of_vectors
from .shared import kept, new_folder
from .sources import annotations
from .streaming import alarms as streaming
from .streaming import filters as stream_filters

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# runs, alarms, events -------------------------------------------------------


@query
def event_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Event-level results per patient: alarms need two windows, merge within two steps, and rest for eight."""
    summary, _, _ = events.tables(predictions(spark, sf), ["patient"], FS, 4.0, 2.0, min_consecutive=2, merge_gap_s=4.0, refractory_s=16.0)
    return rounded(summary, "event_sensitivity", "hours_scored", "fa_per_hour_event", "median_latency_s", "mean_latency_s")


@query
def event_seizures(spark: SparkSession, sf: str) -> DataFrame:
    _, seizures, _ = events.tables(predictions(spark, sf), ["patient"], FS, 4.0, 2.0)
    return seizures.select("file", "onset_sample", "end_sample", "detected", "alarm_raise_sample", F.round("latency_s", 6).alias("latency_s"))


@query
def event_alarms(spark: SparkSession, sf: str) -> DataFrame:
    _, _, alarms = events.tables(predictions(spark, sf), ["patient"], FS, 4.0, 2.0)
    return alarms.select("file", "raise_sample", "end_sample", "in_seizure")


@query
def event_report(spark: SparkSession, sf: str) -> DataFrame:
    """Both halves of the patients as models of one arm, reported over patients."""
    pred = predictions(spark, sf).withColumns({"arm": F.lit("raw"), "model": F.when(F.col("patient") % 2 == 0, "even").otherwise("odd")})
    return events.report(events.tables(pred, ["arm", "model", "patient"], FS, 4.0, 2.0)[0])


@query
def seizure_runs(spark: SparkSession, sf: str) -> DataFrame:
    return events.runs(predictions(spark, sf), ["file"], F.col("y_true") == 1, STEP)


@query
def alarm_runs_merged(spark: SparkSession, sf: str) -> DataFrame:
    found = events.runs(predictions(spark, sf), ["file"], F.col("y_pred") == 1, STEP)
    return events.merged_alarms(found, ["file"], WINDOW, STEP, 2, 1024)


# metrics --------------------------------------------------------------------


@query
def roc_auc_by_patient(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.auc(predictions(spark, sf), ["patient"], "y_true", "y_score"), "auc")


@query
def window_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.window_metrics(predictions(spark, sf), ["patient"], 2.0), *metrics.METRICS)


@query
def metrics_summary(spark: SparkSession, sf: str) -> DataFrame:
    pred = predictions(spark, sf).withColumn("arm", F.when(F.col("patient") % 2 == 0, "even").otherwise("odd"))
    return rounded(metrics.summary(metrics.window_metrics(pred, ["arm", "patient"], 2.0), ["arm"]), "mean", "std", "median")


@query
def roc_auc_tied(spark: SparkSession, sf: str) -> DataFrame:
    """AUC of scores that tie: values in steps of 25."""
    pred = predictions(spark, sf).withColumn("y_score", F.floor(F.col("y_score") / 25))
    return rounded(metrics.auc(pred.withColumn("y_third", (F.col("patient") % 3 == 0).cast("int")), ["kind"], "y_third", "y_score", spread=True), "auc")


# windows --------------------------------------------------------------------


def _recordings_and_seizures(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pred = predictions(spark, sf)
    files = pred.groupBy("patient", "case", "file").agg((F.count(F.lit(1)) * STEP + STEP).alias("n_samples"))
    seizures = events.runs(pred, ["file"], F.col("y_true") == 1, STEP).select("file", (F.col("first") + 300).alias("onset_sample"), (F.col("last") + WINDOW + 700).alias("end_sample"))
    return files, seizures


@query
def sliding_windows_labelled(spark: SparkSession, sf: str) -> DataFrame:
    return windows.labelled(*_recordings_and_seizures(spark, sf), WINDOW, STEP, FS).select("file", "start_sample", "t_start_s", F.col("label").cast("int").alias("label"))


@query
def sliding_windows_keep_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return windows.labelled(*_recordings_and_seizures(spark, sf), WINDOW, STEP, FS, drop_boundary=False).select("file", "start_sample", "t_start_s", F.col("label").cast("int").alias("label"))


@query
def window_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(windows.counts(windows.labelled(*_recordings_and_seizures(spark, sf), WINDOW, STEP, FS)), "ictal_fraction")


# calibration, sampling ------------------------------------------------------


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return predictions(spark, sf).withColumn("label", F.col("y_true"))


@query
def calibration_mask(spark: SparkSession, sf: str) -> DataFrame:
    return calibration.mark(_labelled(spark, sf), 10, 5).select("patient", "file", "start_sample", "is_calibration")


@query
def standardised_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = calibration.arm(_labelled(spark, sf), ["y_score"], "subject_standardised", 10, 5)
    return rows.select("patient", "file", "start_sample", F.round("y_score", 6).alias("y_score"))


@query
def train_allocation(spark: SparkSession, sf: str) -> DataFrame:
    counts = _labelled(spark, sf).where("label = 0").groupBy("patient").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return sampling.allocation(counts.crossJoin(F.broadcast(total)), F.floor(F.col("t") / 3), floor=1)


@query
def train_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled(spark, sf).select("patient", "file", "start_sample", "label")
    return sampling.training(rows, 42, ["file", "start_sample"], ratio=1, most=1 << 40)


@query
def train_sample_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Per patient and class: how many rows a training set of at most 1000 rows takes."""
    rows = _labelled(spark, sf).select("patient", "file", "start_sample", "label")
    return sampling.training(rows, 42, ["file", "start_sample"], ratio=1, most=1000).groupBy("patient", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def shuffled_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A label permutation keeps the number of each label."""
    rows = _labelled(spark, sf).select("patient", "file", "start_sample", "label")
    return sampling.permuted_labels(rows, 7, ["file", "start_sample"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query
def group_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Patients dealt to three inner folds of about equal numbers of windows, and the size of each fold."""
    counts = predictions(spark, sf).groupBy("patient").agg(F.count(F.lit(1)).alias("n"))
    dealt = folds.group_folds(counts, 3)
    sizes = dealt.groupBy("split").agg(F.sum("n").alias("split_windows"), F.count(F.lit(1)).alias("split_patients"))
    return dealt.join(sizes, "split").select("patient", "n", "split", "n_splits", "split_windows", "split_patients")


@query
def training_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Per fold (one of ten patients held out) and patient: how many rows of each class the fold trains on, at most 2000 together."""
    rows = _labelled(spark, sf).select("patient", "case", "file", "start_sample", "label")
    taken = folds.training(rows, list(range(10)), 42, ["case", "file", "start_sample"], ratio=2, most=2000)
    return taken.groupBy("fold", "patient", "label").agg(F.count(F.lit(1)).alias("n"))


# cohort ---------------------------------------------------------------------


@query
def file_index(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.ordered(recordings(spark, sf)).select("patient", "case", "file", "file_order", "duration_s", F.bround(F.col("duration_s") * FS).cast("long").alias("n_samples"), "role")


def _cohort(spark: SparkSession, sf: str) -> DataFrame:
    index = cohort.ordered(recordings(spark, sf))
    bad = index.where("bad is not null").select("file", F.col("bad").alias("reason"))
    return cohort.select(index.drop("bad"), 1.0, bad)


@query
def cohort_selected(spark: SparkSession, sf: str) -> DataFrame:
    return _cohort(spark, sf).select("patient", "file", "file_order", "include", "exclude_reason")


@query
def cohort_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cohort.summary(_cohort(spark, sf), FS), "seizure_free_hours", "total_hours", "cache_gb")


@query
def cohort_validation(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.validate(_cohort(spark, sf))


@query
def exclude_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _cohort(spark, sf).groupBy("exclude_reason").agg(F.count(F.lit(1)).alias("n"))


@query
def patient_map_join(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as cases of a patient map; those without an entry are their own patient."""
    names = {"NATION_1": "p01", "NATION_2": "p01", "NATION_3": "p02"}
    return table(spark, sf, "nation").select("n_name", cohort.patient_of(F.col("n_name"), names).alias("patient"))


@query
def patients_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """Orders from 2022 on replace all older rows of their customers."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("patient"), "o_orderkey", "o_orderstatus")
    new = o.where("o_orderstatus = 'F'")
    return cohort.replace_patients(o.where("o_orderstatus <> 'F'"), new)


@query
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")
    return direction.latest(log, ["o_custkey", "o_orderstatus"], "o_orderkey")


@query
def ratio_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Mean price of each order status as columns, a row per priority."""
    o = table(spark, sf, "orders")
    return rounded(o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice")), "F", "O", "P", digits=4)


# texts ----------------------------------------------------------------------


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    """A summary text per customer: an entry per order, with none, one or two seizures, the second listed with its end before its start for some."""
    o = table(spark, sf, "orders")
    k, s = F.col("o_orderkey"), (F.col("o_orderkey") % 1000).cast("long")
    clock = F.concat_ws(":", (k % 26).cast("string"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("30"))
    clock_end = F.concat_ws(":", ((k + 1) % 26).cast("string"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("31"))
    n = (k % 3).cast("int")
    one = lambda i, a, b: F.concat(F.lit(f"Seizure {i} Start Time: "), a.cast("string"), F.lit(f" seconds\nSeizure {i} End Time: "), b.cast("string"), F.lit(" seconds\n"))
    body = F.concat(
        F.lit("File Name: f"), k.cast("string"), F.lit(".edf\nFile Start Time: "), clock, F.lit("\nFile End Time: "), clock_end, F.lit("\nNumber of Seizures in File: "), n.cast("string"), F.lit("\n"),
        F.when(n >= 1, one(1, s, s + 40)).otherwise(""),
        F.when(n >= 2, one(2, s + 100, s + 100 + (k % 7) - 2)).otherwise(""),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), body.alias("b")))), lambda x: x["b"]), "")
    return o.groupBy(F.col("o_custkey").cast("string").alias("case")).agg(F.concat(F.lit("Data Sampling Rate: 256 Hz\n\n"), text).alias("text"))


@query
def annotation_parse(spark: SparkSession, sf: str) -> DataFrame:
    found = annotations.build(annotations.blocks(_summaries(spark, sf)))
    return found.select("case", "file", F.col("seizure_idx").cast("long").alias("seizure_idx"), "seizure_start_s", "seizure_end_s")


@query
def annotation_durations(spark: SparkSession, sf: str) -> DataFrame:
    return annotations.durations(annotations.blocks(_summaries(spark, sf)))


@query
def annotation_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Declared against parsed numbers of seizures: none differ here."""
    parsed = annotations.blocks(_summaries(spark, sf))
    return parsed.groupBy("declared").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.size("seizures") == F.col("declared")).alias("agree"))


# features -------------------------------------------------------------------


@query
def td_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = windows_of_vectors(spark, sf).withColumn("s", time_domain.summary(F.col("x")))
    return rows.select("vec_id", *[F.round(c, 6).alias(n) for n, c in time_domain.features(F.col("s")).items()])


@query
def line_length(spark: SparkSession, sf: str) -> DataFrame:
    return windows_of_vectors(spark, sf).select("vec_id", F.round(time_domain.line_length(F.col("x")), 6).alias("line_length"))


@query
def window_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 16 samples every 8 of each vector, with their sums."""
    signals = windows_of_vectors(spark, sf).select("vec_id", F.col("x").alias("samples"))
    return windows.slices(signals, 16, 8, 64.0).select("vec_id", "start_sample", "t_start_s", F.round(time_domain.total(F.col("x")), 6).alias("total"))


@query
def chunk_slices(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of ``window_slices`` where every vector lies in chunks of ten samples."""
    starts = F.sequence(F.lit(0), F.lit(63), F.lit(10))
    chunks = windows_of_vectors(spark, sf).select("vec_id", "x", F.posexplode(starts).alias("chunk_idx", "start_sample")).select("vec_id", "chunk_idx", "start_sample", F.slice("x", F.col("start_sample") + 1, 10).alias("samples"))
    found = windows.chunk_slices(chunks, 16, 8, 64.0, keys=("vec_id",), least=10)
    return found.select("vec_id", "start_sample", "t_start_s", F.round(time_domain.total(F.col("x")), 6).alias("total"))


@query
def spectral_features(spark: SparkSession, sf: str) -> DataFrame:
    """All features of every vector as a window of a second at 64 Hz."""
    return feature_table.with_features(windows_of_vectors(spark, sf), 64.0)


def _of_256(spark: SparkSession, sf: str) -> DataFrame:
    """Every four neighbouring vectors as a window of four seconds at 64 Hz."""
    rows = windows_of_vectors(spark, sf).groupBy(F.floor(F.col("vec_id") / 4).alias("window_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("v"))
    return rows.where("size(v) = 4").select("window_id", F.flatten(F.transform("v", lambda v: v["x"])).alias("x"))


@query
def frequency_features(spark: SparkSession, sf: str) -> DataFrame:
    """Log powers and shares of the bands: seven segments of each window of 256 samples."""
    found = feature_table.with_features(_of_256(spark, sf), 64.0, nonlinear=False)
    return found.select("window_id", *[F.round(F.col(f"{kind}_{b}").cast("double"), 4).alias(f"{kind}_{b}") for kind in ("logpow", "rel") for b in config.BANDS])


@query
def wavelet_features(spark: SparkSession, sf: str) -> DataFrame:
    """Log energy and spread of the details and the last approximation of each window of 256 samples."""
    found = feature_table.with_features(_of_256(spark, sf), 64.0, nonlinear=False)
    return found.select("window_id", *[F.round(F.col(f"{kind}_{d}").cast("double"), 4).alias(f"{kind}_{d}") for kind in ("dwt_logE", "dwt_std") for d in config.DETAILS])


@query
def screening_features(spark: SparkSession, sf: str) -> DataFrame:
    """The fifteen features by which filters are screened, of every vector."""
    rows = windows_of_vectors(spark, sf).withColumn("f", screen.cheap_features(64.0)("x"))
    return rows.select("vec_id", *[F.round(F.col("f")[i], 6).alias(n) for i, n in enumerate(kernels.SCREENING)])


@query
def window_features_1024(spark: SparkSession, sf: str) -> DataFrame:
    """All features of windows of 1024 samples at 256 Hz, one every 16 samples: the vectors are chunks, 400 of them make a recording."""
    place = F.col("vec_id") % 400
    chunks = windows_of_vectors(spark, sf).select(F.floor(F.col("vec_id") / 400).alias("recording"), place.alias("chunk_idx"), (place * 64).alias("start_sample"), F.col("x").alias("samples"))
    return feature_table.with_features(windows.chunk_slices(chunks, 1024, 16, 256.0, keys=("recording",), least=64), 256.0)


@query
def sample_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """The entropies of every vector, undecimated values as the feature table has them."""
    return feature_table.with_features(windows_of_vectors(spark, sf), 64.0).select("vec_id", F.round(F.col("sampen").cast("double"), 4).alias("sampen"), F.round(F.col("apen").cast("double"), 4).alias("apen"))


@query
def feature_direction(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(direction.feature_auc(_long(spark, sf), 3), "auc")


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return windows_of_vectors(spark, sf).select("vec_id", "patient", "label", F.posexplode("x").alias("feature", "value"))


@query
def direction_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(direction.summary(direction.feature_auc(_long(spark, sf), 3), 0.05), "separability", "agreement")


@query
def strongest_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(direction.strongest(direction.feature_auc(_long(spark, sf), 3), 12, flipped=3), "consensus", "focus")


@query
def feature_auc_pivot(spark: SparkSession, sf: str) -> DataFrame:
    aucs = rounded(direction.feature_auc(_long(spark, sf), 3), "auc")
    return aucs.groupBy("feature").pivot("patient", list(range(10))).agg(F.first("auc")).select("feature", *[F.col(str(i)).alias(f"p{i}") for i in range(10)])


@query
def feature_sanity(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen features of four channels each: means by label and their change."""
    long = _long(spark, sf).select(F.col("vec_id").alias("window"), "label", (F.col("feature") % 4).alias("channel"), F.floor(F.col("feature") / 4).alias("feature"), "value")
    return rounded(direction.sanity(long), "interictal", "ictal", "pct_change", digits=5)


# leakage --------------------------------------------------------------------


@query
def leakage_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of what breaks each rule, with a split that shares patients on purpose."""
    rows = _labelled(spark, sf)
    marked = calibration.mark(rows, 10, 5)
    scored = marked.where("start_sample >= 2048")
    parts = [
        leakage.shared_patients(rows.where("patient % 3 <> 0"), rows.where("patient % 2 = 0")).agg(F.lit("shared_patients").alias("rule"), F.count(F.lit(1)).alias("n")),
        leakage.split_cases(rows.withColumn("patient", F.col("patient") + F.col("y_pred") * (F.col("patient") % 5 == 0).cast("int"))).agg(F.lit("split_cases").alias("rule"), F.count(F.lit(1)).alias("n")),
        leakage.scored_calibration(scored, marked.where("is_calibration")).agg(F.lit("scored_calibration").alias("rule"), F.count(F.lit(1)).alias("n")),
        leakage.duplicates(rows, ["case", "file", "start_sample"]).agg(F.lit("duplicates").alias("rule"), F.count(F.lit(1)).alias("n")),
        leakage.unknown_patients(table(spark, sf, "customer").select(F.col("c_custkey").alias("patient")), rows).agg(F.lit("unknown_patients").alias("rule"), F.count(F.lit(1)).alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query
def finite_features(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios that are undefined become 0, and how many there were."""
    rows = predictions(spark, sf).withColumn("ratio", F.try_divide(F.col("y_score"), F.col("y_true")))
    fixed = leakage.finite(rows, ["ratio"])
    return fixed.groupBy("kind").agg(F.count_if(F.col("ratio") == 0).alias("n_zero"), F.round(F.sum("ratio"), 4).alias("total"))


# comparison, learning -------------------------------------------------------


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    """Window metrics of two arms: the scores as they are, and standardised with threshold 0.5."""
    rows = _labelled(spark, sf)
    scaled = calibration.arm(rows, ["y_score"], "subject_standardised", 10, 5).withColumn("y_pred", (F.col("y_score") > 0.5).cast("int"))
    both = rows.withColumn("arm", F.lit("raw")).unionByName(scaled.withColumn("arm", F.lit("standardised")), allowMissingColumns=True)
    return metrics.window_metrics(both.withColumn("model", F.lit("rule")), ["arm", "model", "patient"], 2.0)


@query
def arm_compare_means(spark: SparkSession, sf: str) -> DataFrame:
    p = compare.pairs(_arms(spark, sf), "raw", [str(i) for i in range(50)], ["sensitivity", "specificity", "auc"])
    out = p.groupBy("arm", "subset", "metric").agg(F.count(F.lit(1)).alias("n_patients"), F.avg("reference_value").alias("mean_reference"), F.avg("value").alias("mean_arm"), F.avg(F.col("value") - F.col("reference_value")).alias("mean_diff"))
    return rounded(out, "mean_reference", "mean_arm", "mean_diff")


@query
def arm_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """The same with exact Wilcoxon tests and bootstrap intervals."""
    return compare.arms(_arms(spark, sf), "raw", [str(i) for i in range(50)], ["sensitivity", "specificity", "auc"])


@query
def arm_tests(spark: SparkSession, sf: str) -> DataFrame:
    """What is exact of ``arm_comparison``: directions and p-values."""
    found = compare.arms(_arms(spark, sf), "raw", [str(i) for i in range(50)], ["sensitivity", "specificity", "auc"], n_boot=100)
    return found.select("arm", "subset", "metric", "n_patients", "n_arm_greater", "n_reference_greater", F.round("p_value", 9).alias("p_value"), F.round("min_possible_p", 9).alias("min_possible_p"))


@query
def loso_rf(spark: SparkSession, sf: str) -> DataFrame:
    return loso.evaluate(loso.vectors(spark, sf), "rf")


@query
def loso_svm(spark: SparkSession, sf: str) -> DataFrame:
    return loso.evaluate(loso.vectors(spark, sf), "svm")


@query
def loso_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Window metrics where every fold chooses the cost of its machine on inner folds of patients."""
    return loso.evaluate(loso.vectors(spark, sf), "svm", grid={"C": [1, 10], "gamma": ["scale"]})


@query
def label_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """AUC after the training labels were permuted."""
    return loso.shuffle_check(loso.vectors(spark, sf), "rf", patients=4, seed=1)


# adaptive filters -----------------------------------------------------------


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    """Values of each user as one channel, a chunk per recording in order of time."""
    rows = predictions(spark, sf)
    chunk = F.transform(F.array_sort(F.collect_list(F.struct("start_sample", "y_score"))), lambda v: v["y_score"])
    files = rows.groupBy("case", "file").agg(chunk.alias("samples"))
    return files.select("case", F.lit("C1").alias("channel"), "file", F.substring_index("file", "_", -1).cast("int").alias("file_order"), F.lit(0).alias("chunk_idx"), "samples")


@query
def nlms_filter(spark: SparkSession, sf: str) -> DataFrame:
    return adaptive.run(_signals(spark, sf), "nlms", {"length": 4}, fs=1.0, warm_start_s=20.0).select("case", "file", "status", F.round("rms_in", 4).alias("rms_in"), F.round("rms_out", 4).alias("rms_out"))


@query
def rls_filter(spark: SparkSession, sf: str) -> DataFrame:
    return adaptive.run(_signals(spark, sf), "rls", {"length": 4}, fs=1.0, warm_start_s=20.0).select("case", "file", "status", F.round("rms_in", 4).alias("rms_in"), F.round("rms_out", 4).alias("rms_out"))


@query
def kalman_filter(spark: SparkSession, sf: str) -> DataFrame:
    return adaptive.run(_signals(spark, sf), "kalman", {"block_s": 8.0}, fs=1.0, warm_start_s=0.0).select("case", "file", "status", F.round("rms_in", 4).alias("rms_in"), F.round("rms_out", 4).alias("rms_out"))


@query
def kalman_gain(spark: SparkSession, sf: str) -> DataFrame:
    """Log amplitude after the last whole block of four events of each user: block sums in one grouping, the recursion as a fold."""
    rows = table(spark, sf, "events").select("user_id", "value", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("at"))
    blocks = rows.groupBy("user_id", F.floor(F.col("at") / 4).alias("block")).agg(F.sum(F.col("value") * F.col("value")).alias("ss"), F.count(F.lit(1)).alias("n")).where("n = 4")
    z = F.greatest(F.least(0.5 * F.log(F.col("ss") / 4 + 1e-6), F.lit(9.210340371976184)), F.lit(-2.302585092994046))
    listed = blocks.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", z.alias("z")))), lambda b: b["z"]).alias("z"))
    return listed.select("user_id", F.size("z").cast("long").alias("n_blocks"), F.round(F.element_at(adaptive.tracked(F.col("z"), 0.1), -1), 6).alias("log_amplitude"))


@query
def power_contrast(spark: SparkSession, sf: str) -> DataFrame:
    """Mean power inside and before each seizure, and their ratio."""
    return screen.contrast(predictions(spark, sf))


@query
def screen_settings(spark: SparkSession, sf: str) -> DataFrame:
    """How much of the separability of vectors of one label each setting of the pilot grid keeps."""
    return screen.separability_kept(windows_of_vectors(spark, sf), settings=config.grid())


# streams --------------------------------------------------------------------


@query
def stream_kalman(spark: SparkSession, sf: str) -> DataFrame:
    """The log amplitudes of ``kalman_gain`` from a stream of events with state per user."""
    streaming.use_rocksdb(spark)
    source = table(spark, sf, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf}/events.parque[t]").select(F.col("user_id").cast("string").alias("case"), "ts", "event_id", "value")
    out = streaming.drained(streaming.amplitudes(stream, block=4, q_over_r=0.1))
    last = out.groupBy("case").agg(F.count(F.lit(1)).alias("n_blocks"), F.round(F.max_by("log_amplitude", "block"), 6).alias("log_amplitude"))
    return last.select(F.col("case").cast("long").alias("user_id"), "n_blocks", "log_amplitude")


def _stream_of_signals(spark: SparkSession, sf: str) -> DataFrame:
    streaming.use_rocksdb(spark)
    path, signals = new_folder(spark), _signals(spark, sf)
    signals.write.parquet(path)
    return spark.readStream.schema(signals.schema).parquet(path)


@query
def stream_nlms(spark: SparkSession, sf: str) -> DataFrame:
    """The results of ``nlms_filter`` from a stream of chunks with the filter's state per user."""
    out = streaming.drained(stream_filters.filtered(_stream_of_signals(spark, sf), "nlms", {"length": 4}, 1.0, 20.0))
    return out.select("case", "file", "status", F.round("rms_in", 4).alias("rms_in"), F.round("rms_out", 4).alias("rms_out"))


@query
def stream_rls(spark: SparkSession, sf: str) -> DataFrame:
    """The results of ``rls_filter`` from a stream that goes on from the states of a batch run over each user's first recording."""
    signals = kept(_signals(spark, sf))
    first = signals.groupBy("case").agg(F.min("file_order").alias("file_order"))
    # a batch run over the first recordings of those that are longer than the warm start gives the states to begin with
    begun = signals.join(first, ["case", "file_order"]).where(F.size("samples") >= 20)
    batch = kept(adaptive.run(begun, "rls", {"length": 4}, fs=1.0, warm_start_s=20.0))
    path, rest = new_folder(spark), signals.join(begun.select("file"), "file", "left_anti").select(*signals.columns)
    rest.write.parquet(path)
    streaming.use_rocksdb(spark)
    stream = spark.readStream.schema(signals.schema).parquet(path)
    out = streaming.drained(stream_filters.filtered(stream, "rls", {"length": 4}, 1.0, 20.0, adaptive.states(batch, "rls", {"length": 4}, 20.0)))
    columns = ["case", "file", "status", F.round("rms_in", 4).alias("rms_in"), F.round("rms_out", 4).alias("rms_out")]
    return batch.select(*columns).unionByName(out.select(*columns))


@query
def stream_alarms(spark: SparkSession, sf: str) -> DataFrame:
    """The alarms of ``event_summary`` from a stream of window predictions with state per recording."""
    streaming.use_rocksdb(spark)
    path = new_folder(spark)
    pred = predictions(spark, sf).select("file", "start_sample", "y_pred")
    pred.write.parquet(path)
    stream = spark.readStream.schema(pred.schema).parquet(path)
    return streaming.drained(streaming.alarms(stream, WINDOW, STEP, min_consecutive=2, merge_gap=1024, refractory=4096))
