import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill import __main__ as main
from wavemill import config
from wavemill.plans import entries
from wavemill.sources import edf


def tree(root, cfg, cases=("p1", "p2"), other_names=None):
    """A small raw tree of two cases, three recordings of 40 s each, a louder 3 Hz rhythm in the second one."""
    rng = np.random.default_rng(0)
    fs, names = int(cfg["dataset"]["fs"]), [(other_names or {}).get(c, c) for c in cfg["dataset"]["channels"]]
    records = []
    for case in cases:
        (root / "raw" / case).mkdir(parents=True)
        text = "Data Sampling Rate: 64 Hz\n\n"
        for i in range(3):
            x = rng.normal(size=(len(names), fs * 40)) * 20
            seizure = i == 1
            if seizure:
                x[:, fs * 12 : fs * 26] += 120 * np.sin(2 * np.pi * 3 * np.arange(fs * 14) / fs)
            file = f"{case}_{i + 1:02d}.edf"
            edf.write(str(root / "raw" / case / file), names if not ((case,) == cases[1:2] and i == 2) else ["X", *names[1:]], x, fs)
            records.append(f"{case}/{file}")
            text += f"File Name: {file}\nFile Start Time: 10:0{i}:00\nFile End Time: 10:0{i}:40\nNumber of Seizures in File: {int(seizure)}\n"
            text += "Seizure Start Time: 12 seconds\nSeizure End Time: 26 seconds\n" if seizure else ""
        (root / "raw" / case / f"{case}-summary.txt").write_text(text)
    (root / "raw" / "RECORDS").write_text("\n".join(records) + "\n")


def test_from_recordings_to_reports(spark, tmp_path):
    cfg = config.load(overrides={"dataset": {"fs": 64}, "filter": {"high": 28.0, "notch": 30.0}, "features": {"nonlinear": False}, "evaluation": {"calibration": {"minutes": 0.2, "min_windows": 2}}})
    root = str(tmp_path)
    tree(tmp_path, cfg)
    index = entries.index(spark, root, cfg)
    assert index.where("include").count() == 5
    assert index.where("not include").first()["exclude_reason"] == f"missing_channel:{config.CHANNELS[0]}"
    assert entries.preprocess(spark, root, cfg).where("status = 'success'").count() == 5
    counts = entries.make_windows(spark, root, cfg).collect()
    assert len(counts) == 2 and all(r["n_ictal"] > 0 for r in counts)
    assert entries.extract_features(spark, root, cfg).first()["replaced"] == 0
    wide = spark.read.parquet(f"{root}/features")
    assert len([c for c in wide.columns if c.startswith("f_")]) == 18 * 30
    assert entries.check_contract(spark, root).count() == 0
    per_patient = entries.baseline(spark, root, cfg, ["raw"], ["rf"], most_patients=2)
    assert [r["auc"] > 0.9 for r in per_patient.collect()] == [True, True]
    chosen = spark.read.option("header", True).csv(f"{root}/reports/chosen").collect()
    assert {(r["model"], r["patient"]) for r in chosen} == {("rf", "p1"), ("rf", "p2")} and all("200" in r["setting"] for r in chosen)  # one training patient: the fixed setting
    assert entries.baseline(spark, root, cfg, ["raw"], ["svm"], patients=["p1"]).where("model = 'svm'").count() == 0  # nobody to train on
    out = entries.report(spark, root, cfg, reference="none", tag="_strict")
    assert out["events"].first()["n_detected"] == 2 and (tmp_path / "reports/events_strict").exists()
    shown = lambda *args: main.run(spark, main.parser().parse_args([args[0], root, "--config", str(tmp_path / "settings.yaml"), *args[1:]]))
    (tmp_path / "settings.yaml").write_text("features: {nonlinear: false}\ndataset: {fs: 64}\nevaluation: {fixed_params: {rf: {n_estimators: 5}}}\n")
    summary, strongest = shown("directions", "--focus", "p2", "--top", "3", "--min-ictal", "2")
    assert summary.count() == 2 and strongest.count() == 3 and {"focus", "consensus", "flipped"} <= set(strongest.columns)
    with pytest.raises(ValueError, match="too few ictal"):
        shown("directions", "--focus", "p2", "--min-ictal", "1000")
    assert shown("sanity", "--cases", "p1")[0].count() == 30
    runs = shown("shuffle", "--models", "rf", "--n-test", "1", "--seeds", "0,1", "--tuning", "fixed")[0].collect()
    assert [(r["model"], r["seed"], r["n_test_patients"], r["n_patients_available"], r["tuning_mode"]) for r in runs] == [("rf", 0, 1, 2, "fixed"), ("rf", 1, 1, 2, "fixed")]
    assert spark.read.parquet(f"{root}/logs/label_shuffle").count() == 2
    log = entries.adapt(spark, root, cfg, "kalman", {"block_s": 0.5}, warm_start_s=5.0, patients=["p1"])
    assert log.count() == 3 and log.where("status = 'success'").count() == 3
    assert entries.adaptive_ratios(spark, root).columns == ["file", "kalman_qr0.0001_blk0.5_ws5"]
    assert wide.select(F.countDistinct("case")).first()[0] == 2


def test_patient_map_and_channel_aliases_of_the_settings(spark, tmp_path):
    cfg = config.load(overrides={"dataset": {"fs": 64, "channel_aliases": {"right": "T8-P8"}}, "filter": {"high": 28.0, "notch": 30.0}})
    tree(tmp_path, cfg, ("chb01", "chb21"), {"T8-P8": "right", "P8-O2": "P8-O2-0"})
    index = entries.index(spark, str(tmp_path), cfg)
    assert {r["patient"] for r in index.select("patient").collect()} == {"chb01"} and index.where("include").count() == 6 - 1
    assert {r["patient"] for r in spark.read.parquet(f"{tmp_path}/tables/annotations").collect()} == {"chb01"}
    assert entries.preprocess(spark, str(tmp_path), cfg).where("status = 'success'").count() == 5
    assert {r["channel"] for r in spark.read.parquet(f"{tmp_path}/signals").select("channel").distinct().collect()} == set(config.CHANNELS)


def test_later_runs_go_on_where_earlier_ones_ended(spark, tmp_path):
    cfg = config.load(overrides={"dataset": {"fs": 64}, "filter": {"high": 28.0, "notch": 30.0}})
    root = str(tmp_path)
    tree(tmp_path, cfg, ("p1",))
    entries.index(spark, root, cfg)
    statuses = lambda log: [r["status"] for r in log.orderBy("file").collect()]
    assert statuses(entries.preprocess(spark, root, cfg)) == ["success"] * 3
    shutil.rmtree(tmp_path / "signals/case=p1/file=p1_02.edf")
    assert statuses(entries.preprocess(spark, root, cfg)) == ["skipped_existing", "success", "skipped_existing"]
    adapt = lambda **o: entries.adapt(spark, root, cfg, "nlms", {"length": 4}, warm_start_s=5.0, **o)
    assert statuses(adapt()) == ["success"] * 3
    path = "adaptive/nlms_L4_mu0.005_ws5"
    table = lambda: [(r["file"], r["channel"], r["samples"]) for r in spark.read.parquet(f"{root}/{path}").orderBy("file", "channel").collect()]
    whole = table()
    assert statuses(adapt()) == ["skipped_existing"] * 3 and table() == whole
    shutil.rmtree(tmp_path / path / "case=p1/file=p1_02.edf")
    assert statuses(adapt()) == ["skipped_existing", "success", "recomputed_downstream"] and table() == whole
    assert statuses(adapt(overwrite=True)) == ["success"] * 3 and table() == whole
