import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill import config, schemas
from wavemill.functions import adaptive, features, filters, kernels, time_domain
from wavemill.operators import arrays, calibration, chunks, cohort, compare, direction, events, leakage, metrics, sampling, windows
from wavemill.sources import annotations, edf, tables

PRED = "patient string, case string, file string, start_sample long, y_true int, y_pred int"


def predictions(spark, true, pred, n=30):
    return spark.createDataFrame([("p", "c", "f", 512 * i, int(i in true), int(i in pred)) for i in range(n)], PRED)


@pytest.mark.parametrize(
    ("pred", "options", "expected"),
    [
        (range(10, 15), {}, (1, 0, 4.0)),
        ((12, 13, 14), {}, (1, 0, 8.0)),
        ((), {}, (0, 0, None)),
        ((2, 3, 4, 20, 21), {}, (0, 2, None)),
        ((3, *range(10, 15), 20, 21), {"min_consecutive": 2}, (1, 1, 6.0)),
        ((10, 11, 13, 14), {}, (1, 0, 4.0)),
    ],
)
def test_event_goldens(spark, pred, options, expected):
    summary, _, _ = events.tables(predictions(spark, range(10, 15), pred), ["patient"], 256, 4.0, 2.0, **options)
    r = summary.first()
    assert (r["n_detected"], r["n_false_alarms"], r["median_latency_s"]) == expected
    assert r["hours_scored"] == pytest.approx(60 / 3600)


@pytest.mark.parametrize(("refractory", "n"), [(30, 1), (20, 2), (10, 2)])
def test_refractory_is_strict(spark, refractory, n):
    summary, _, _ = events.tables(predictions(spark, (), (2, 12)), ["patient"], 256, 4.0, 2.0, refractory_s=refractory)
    assert summary.first()["n_false_alarms"] == n


@pytest.mark.parametrize(("gap", "n"), [(None, 2), (4.0, 1)])
def test_merge_gap(spark, gap, n):
    summary, _, _ = events.tables(predictions(spark, (), (2, 4)), ["patient"], 256, 4.0, 2.0, merge_gap_s=gap)
    assert summary.first()["n_alarms"] == n


def test_validation_of_predictions(spark):
    twice = predictions(spark, (), ()).union(predictions(spark, (), ()))
    with pytest.raises(ValueError, match="repeat"):
        events.validate(twice, 2.0, 1, 0)
    with pytest.raises(ValueError):
        events.validate(predictions(spark, (), ()), 2.0, 0, 0)


@pytest.mark.parametrize(("n", "expected"), [(1023, 0), (1024, 1), (1535, 1), (1536, 2), (3584, 6), (10752, 20)])
def test_window_count(spark, n, expected):
    assert windows.cut(spark.createDataFrame([("f", n)], "file string, n_samples long"), 1024, 512, 256).count() == expected


def test_labels(spark):
    rec = spark.createDataFrame([("f", 1024 + 9 * 512)], "file string, n_samples long")
    on = lambda a, b: spark.createDataFrame([("f", a, b)], "file string, onset_sample long, end_sample long")
    ictal = lambda df: {r["start_sample"] for r in df.where("label = 1").collect()}
    assert ictal(windows.labelled(rec, on(1024, 2560), 1024, 512, 256)) == {1024, 1536}
    kept = {r["start_sample"] for r in windows.labelled(rec, on(1200, 2200), 1024, 512, 256).collect()}
    assert {512, 1024, 1536, 2048}.isdisjoint(kept)
    assert ictal(windows.labelled(rec, on(1200, 2200), 1024, 512, 256, drop_boundary=False)) == {512, 1024, 1536, 2048}


def test_bisection_order(spark):
    rows = spark.range(8).select("id", cohort.bisection_key(F.col("id"), F.lit(8)).alias("k")).orderBy("k").collect()
    assert [r["id"] for r in rows] == [4, 2, 6, 1, 3, 5, 7, 0]


def test_cohort_fills_to_the_cap_and_checks_again(spark):
    rows = [("p", "c", f"c_{i:02d}", 3600.0, "seizure" if 1 <= i <= 3 else "seizure_free") for i in range(12)]
    index = cohort.ordered(spark.createDataFrame(rows, "patient string, case string, file string, duration_s double, role string"))
    chosen = cohort.select(index, 3.0)
    assert chosen.where("include").count() == 3 + 1 + 2
    bad = lambda included: included.where("file = 'c_00'").select("file", F.lit("missing_channel:X").alias("reason"))
    again = cohort.fixed_point(index, 3.0, bad)
    assert again.where("file = 'c_00'").first()["exclude_reason"] == "missing_channel:X"
    assert cohort.select(index.where("role = 'seizure_free'"), 3.0).where("include").count() == 0


def test_channels_and_headers(spark):
    have = spark.createDataFrame([(["A", "B-0", "Z"],)], "ch array<string>")
    assert have.select(cohort.resolve_channels(F.col("ch"), ["A", "B", "C", "D"], {"C": ["Y", "Z"]}).alias("r")).first()["r"] == ["A", "B-0", "Z", None]
    head = spark.createDataFrame([("a", None, 256.0, ["A", "B"]), ("b", "OSError", None, None), ("c", None, 128.0, ["A", "B"]), ("d", None, 256.0, ["A"])], "file string, error string, sfreq double, ch_names array<string>")
    assert [r["reason"] for r in cohort.usable(head, ["A", "B"]).orderBy("file").collect()] == [None, "unreadable_edf:OSError", "bad_fs:128.0", "missing_channel:B"]
    other = spark.createDataFrame([("a", None, 256.0, ["X-Y", "T8-P8-0"]), ("b", None, 256.0, ["X-Y", "Q"]), ("c", None, 256.0, ["X-Y", "P8-T8"])], head.schema)
    assert [r["reason"] for r in cohort.usable(other, ["X-Y", "T8-P8"], aliases={"T8-P8": ["Q"]}).orderBy("file").collect()] == [None, None, "missing_channel:T8-P8"]
    assert edf.resolve(["X-Y", "Q", "T8-P8-0"], ["T8-P8", "X-Y"], config.aliases({"dataset": {"channel_aliases": {"Q": "T8-P8"}}})) == [1, 0]


def test_calibration_falls_back(spark):
    rows = spark.createDataFrame([("p", "c", "f", i, int(i == 3)) for i in range(20)], "patient string, case string, file string, start_sample long, label int")
    assert [r[0] for r in calibration.mark(rows, 5, 2).where("is_calibration").select("start_sample").orderBy("start_sample").collect()] == [0, 1, 2]
    assert [r[0] for r in calibration.mark(rows, 5, 10).where("is_calibration").select("start_sample").orderBy("start_sample").collect()] == [0, 1, 2, 4, 5]


def test_allocation_adds_up(spark):
    counts = spark.createDataFrame([("a", 10), ("b", 20), ("c", 3)], "patient string, n long")
    got = {r["patient"]: r["alloc"] for r in sampling.allocation(counts, F.lit(10), floor=1).collect()}
    assert sum(got.values()) == 10 and min(got.values()) >= 1
    assert {r["alloc"] for r in sampling.allocation(counts, F.lit(100)).collect()} == {10, 20, 3}


def test_wilcoxon_and_bootstrap():
    assert compare.wilcoxon([1, 2, 3, 4, 5], [0, 0, 0, 0, 0])["p_value"] == pytest.approx(0.0625)
    assert compare.wilcoxon([1, 2, 3, 4, 5, 6], [0] * 6)["p_value"] == pytest.approx(0.03125)
    assert compare.wilcoxon([1, 2, 3, 4, 5, 6], [0] * 6, "greater")["p_value"] == pytest.approx(0.015625)
    assert compare.wilcoxon([1, np.nan, 2], [1, 3, 2])["p_value"] == 1.0
    low, high = compare.bootstrap([1.0, 2.0, 3.0, 4.0], n_boot=2000)
    assert 1 <= low < 2.5 < high <= 4 and compare.bootstrap([1.0]) == (None, None)


def test_wilcoxon_of_any_size():
    rng = np.random.default_rng(4)
    d = np.rint(rng.normal(0.3, 1, 10) * 4)
    d[d == 0] = 1  # with ties
    ranks = compare.average_ranks(np.abs(d))
    sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=10)]
    up = ranks[d > 0].sum()
    assert compare.wilcoxon(d, 0 * d, "greater")["p_value"] == pytest.approx(np.mean([s >= up for s in sums]))
    assert compare.wilcoxon(d, 0 * d, "less")["p_value"] == pytest.approx(np.mean([s <= up for s in sums]))
    with np.errstate(all="raise", under="ignore"):
        for n in (10, 50, 500, 1100, 5000):
            d = rng.normal(0.05, 1, n)
            exact, normal = compare.wilcoxon(d, 0 * d, exact=1200), compare.wilcoxon(d, 0 * d, exact=0)
            assert 0 < exact["p_value"] < 1 and exact["p_value"] == pytest.approx(normal["p_value"], abs=0.5 / n)
    assert compare.wilcoxon(np.arange(1, 2001), np.zeros(2000))["p_value"] < 1e-100


def test_arms_of_many_patients(spark):
    def table(n):
        rows = [(arm, "m", i, None if i % 50 == 7 else (i * 37 % 101 + (i % 9 - 3) * (arm == "new")) / 100) for arm in ("raw", "new") for i in range(n)]
        return spark.createDataFrame(rows, "arm string, model string, patient long, auc double")

    for r in compare.arms(table(1600), "raw", [str(i) for i in range(60)], ["auc"], n_boot=200).collect():
        assert 0 <= r["p_value"] <= 1 and r["ci_low"] < r["mean_diff"] < r["ci_high"]
    few = table(200)
    exact, large = ({r["subset"]: r for r in compare.arms(few, "raw", [str(i) for i in range(60)], ["auc"], exact=most).collect()} for most in (500, 0))
    for k in ("all", "dev", "eval"):
        a, b = exact[k], large[k]
        assert all(a[c] == b[c] for c in ("n_patients", "n_arm_greater", "n_reference_greater", "min_possible_p", "mean_arm"))
        assert a["mean_diff"] == pytest.approx(b["mean_diff"]) and a["p_value"] == pytest.approx(b["p_value"], abs=0.01)
        assert a["ci_low"] == pytest.approx(b["ci_low"], abs=1e-3) and a["ci_high"] == pytest.approx(b["ci_high"], abs=1e-3)


def test_direction_of_a_flipped_patient(spark):
    rows = [(p, f, 0.2 if p == 5 else 0.8) for p in range(1, 6) for f in range(4)]
    aucs = spark.createDataFrame(rows, "patient long, feature long, auc double")
    got = {r["patient"]: r["agreement"] for r in direction.summary(aucs).collect()}
    assert got[5] == 0.0 and got[1] == 1.0
    two = direction.summary(aucs.where("patient < 3")).first()
    assert two["agreement"] is None and two["n_strong_features"] == 0


def test_consensus_of_the_others(spark):
    rng = np.random.default_rng(6)
    rows = [(p, f, None if (p + f) % 7 == 0 else float(np.round(rng.random(), 1))) for f in range(6) for p in range(4 + f)] + [(0, 99, None), (1, 98, 0.5)]
    got = {(r["patient"], r["feature"]): (r["consensus"], r["n_others"], r["auc"]) for r in direction.consensus(spark.createDataFrame(rows, "patient long, feature long, auc double")).collect()}
    assert len(got) == len(rows)
    for p, f, auc in rows:
        others = [a for q, g, a in rows if g == f and q != p and a is not None]
        want = (pytest.approx(np.median(others)) if others else None, len(others), auc)
        assert got[p, f] == want


def test_ranks_over_ranges_give_the_same_auc(spark):
    rows = spark.createDataFrame([(k, int((i * 7 + k) % 3 == 0), float(i % 17)) for k in range(2) for i in range(300)] + [(None, 1, 1.0), (None, 0, 0.0), (5, 1, 1.0)], "k long, y int, s double")
    assert sorted(map(str, metrics.auc(rows, ["k"], "y", "s", spread=True).collect())) == sorted(map(str, metrics.auc(rows, ["k"], "y", "s").collect()))


def test_permuted_labels_are_dealt_among_all_rows(spark):
    rows = spark.createDataFrame([(str(i), int(i < 30)) for i in range(300)], "file string, label int")
    got = {r["file"]: r["label"] for r in sampling.permuted_labels(rows, 3, ["file"]).collect()}
    assert len(got) == 300 and sum(got.values()) == 30 and sum(got[str(i)] for i in range(30)) < 12


def test_leakage(spark):
    rows = spark.createDataFrame([("p", "c"), ("q", "c")], "patient string, case string")
    assert leakage.split_cases(rows).count() == 1
    with pytest.raises(ValueError):
        leakage.require_none(leakage.shared_patients(rows, rows), "shared")


def test_time_domain(spark):
    def of(x):
        df = spark.createDataFrame([([float(v) for v in x],)], "x array<double>")
        return df.select(time_domain.summary(F.col("x")).alias("s")).select(*[c.alias(n) for n, c in time_domain.features(F.col("s")).items()]).first().asDict()

    flat = of([7] * 64)
    assert flat["mean"] == 7 and all(v == 0 for k, v in flat.items() if k != "mean" and k != "kurt")
    assert of(2 * np.arange(100))["line_length"] == 2 * 99
    t = np.arange(1024) / 256
    sine = of(np.sin(2 * np.pi * 5 * t))
    assert sine["hjorth_mobility"] == pytest.approx(2 * np.pi * 5 / 256, rel=0.02) and sine["hjorth_complexity"] == pytest.approx(1, rel=0.02)


def test_spectra_and_wavelets():
    t = np.arange(1024) / 256
    x = 2 * np.sin(2 * np.pi * 10 * t)[None]
    f = kernels.frequency_features(x, 256)[0]
    assert f[5 + 2] > 0.99 and f[5:].sum() == pytest.approx(1, abs=0.02)
    c = kernels.wavelet_coefficients(x)
    assert [c[k].shape[1] for k in config.DETAILS] == [515, 261, 134, 70, 38, 38]
    for hz, detail in ((6, "d5"), (12, "d4"), (24, "d3")):
        e = {k: (v**2).sum() for k, v in kernels.wavelet_coefficients(np.sin(2 * np.pi * hz * t)[None]).items()}
        assert max(e, key=e.get) == detail


def test_entropies_by_brute_force():
    x = np.random.default_rng(0).normal(size=(1, 60))
    y = x[0, ::2]
    r, n = 0.2 * y.std(), len(x[0, ::2])
    near = lambda i, j, m: max(abs(y[i + k] - y[j + k]) for k in range(m)) <= r
    b = sum(near(i, j, 2) for i in range(n - 2) for j in range(n - 2) if i != j)
    a = sum(near(i, j, 3) for i in range(n - 2) for j in range(n - 2) if i != j)
    phi = lambda m: np.mean([np.log(np.mean([near(i, j, m) for j in range(n - m + 1)])) for i in range(n - m + 1)])
    got = kernels.entropies(x)[0]
    assert (np.isnan(got[0]) and not a) or got[0] == pytest.approx(-np.log(a / b))
    assert got[1] == pytest.approx(phi(2) - phi(3))
    assert np.isnan(kernels.entropies(np.ones((1, 64)))).all()


def test_filters():
    cfg = config.DEFAULTS["filter"]
    h = filters.bandpass(256, cfg["low"], cfg["high"], cfg["ripple_db"], cfg["transition"])
    assert len(h) == 931
    assert filters.response(h, 256, [0, 0.5, 45, 60]) == pytest.approx([-55.2, -6.0, -6.0, -112.5], abs=0.1)
    t = np.arange(256 * 30) / 256
    y = filters.apply(np.sin(2 * np.pi * 10 * t) + np.sin(2 * np.pi * 60 * t) + 5, 256, cfg)
    assert len(y) == len(t) and np.abs(y[2000:-2000] - np.sin(2 * np.pi * 10 * t)[2000:-2000]).max() < 0.02
    assert len(filters.apply(np.ones(10), 256, cfg)) == 10


def test_preprocess_reports_bad_channels(spark):
    samples = {"A": [float(i % 7) for i in range(600)], "B": [0.0] * 600, "C": [float("nan")] * 10, "D": [float(2e4 * (i % 9 - 4)) for i in range(600)], "E": []}
    rows = [("c", "f", c, i, at, x[at : at + 250]) for c, x in samples.items() for i, at in enumerate(range(0, max(1, len(x)), 250))]
    df = spark.createDataFrame(rows, "case string, file string, channel string, chunk_idx int, start_sample long, samples array<float>")
    got = {r["channel"]: (r["status"], r["n_samples"]) for r in filters.channels(filters.preprocess(df, 256, config.DEFAULTS["filter"])).collect()}
    assert got == {"A": ("success", 600), "B": ("flat", 600), "C": ("failed", 10), "D": ("implausible", 600), "E": ("flat", 0)}


def chunks_of(spark, channels, size):
    rows = [("c", "f", name, i, at, x[at : at + size].tolist()) for name, x in channels.items() for i, at in enumerate(range(0, len(x), size))]
    return spark.createDataFrame(rows, "case string, file string, channel string, chunk_idx int, start_sample long, samples array<float>")


@pytest.mark.parametrize(("n", "size"), [(9000, 2500), (9000, 400), (5000, 4999), (700, 64), (300, 1000)])
def test_chunks_are_filtered_as_whole_channels(spark, n, size):
    rng = np.random.default_rng(n + size)
    channels = {c: (rng.normal(size=n) * 40 + 900 + 30 * np.sin(np.arange(n) * 1.47)).astype(np.float32) for c in "AB"}
    filtered = filters.preprocess(chunks_of(spark, channels, size), 256, config.DEFAULTS["filter"])
    got = filtered.orderBy("channel", "chunk_idx").collect()
    for c, x in channels.items():
        whole = filters.apply(x, 256, config.DEFAULTS["filter"])
        mine = np.concatenate([r["samples"] for r in got if r["channel"] == c])
        assert len(mine) == n and np.abs(mine - whole).max() <= 4 * np.finfo(np.float32).eps * np.abs(x).max()
    std = {r["channel"]: r["std"] for r in filters.channels(filtered).collect()}
    assert std == pytest.approx({c: float(filters.apply(x, 256, config.DEFAULTS["filter"]).std()) for c, x in channels.items()}, rel=1e-5)


def test_a_day_is_never_in_one_row(spark):
    fs, cfg = 64, {**config.DEFAULTS["filter"], "high": 28.0, "notch": 30.0}
    rng = np.random.default_rng(0)
    x = rng.normal(size=24 * 3600 * fs).astype(np.float32)
    size = 600 * fs
    with_more = chunks.with_halo(chunks_of(spark, {"A": x}, size), filters.halo(fs, cfg), filters.halo(fs, cfg), size)
    assert with_more.agg(F.max(F.size("samples")), F.count(F.lit(1))).first() == (size + 2 * filters.halo(fs, cfg), 144)
    got = filters.preprocess(chunks_of(spark, {"A": x}, size), fs, cfg, size).orderBy("chunk_idx").select("samples").collect()
    assert np.abs(np.concatenate([r["samples"] for r in got]) - filters.apply(x, fs, cfg)).max() < 1e-5


def test_halo_by_plain_slices(spark):
    rng = np.random.default_rng(2)
    sizes = {"A": [5, 7, 3, 3, 9, 1], "B": [4], "C": [6, 2]}  # uneven, the last one shorter
    rows, whole = [], {}
    for c, of in sizes.items():
        whole[c] = [float(v) for v in range(sum(of))]
        at = 0
        for i, n in enumerate(of):
            rows.append(("c", "f", c, i, at, whole[c][at : at + n]))
            at += n
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r[:3]) + (int(r[3]), int(r[4]), list(r[5])) for r in rows], "case string, file string, channel string, chunk_idx int, start_sample long, samples array<float>")
    for before, after in ((0, 0), (4, 0), (0, 6), (2, 3), (11, 12), (100, 100)):
        got = {(r["channel"], r["chunk_idx"]): (r["start_sample"], r["n_samples"], r["lead"], r["samples"]) for r in chunks.with_halo(df, before, after).collect()}
        want = {(r[2], r[3]): (r[4], len(r[5]), r[4] - max(0, r[4] - before), whole[r[2]][max(0, r[4] - before) : r[4] + len(r[5]) + after]) for r in rows}
        assert got == want


@pytest.mark.parametrize(("length", "step", "size"), [(16, 8, 10), (10, 3, 25), (5, 7, 4), (64, 64, 30), (65, 1, 30)])
def test_windows_across_chunks(spark, length, step, size):
    channels = {c: np.arange(64, dtype=np.float32) + k for k, c in enumerate("AB")}
    whole = windows.slices(spark.createDataFrame([("c", "f", c, x.tolist()) for c, x in channels.items()], "case string, file string, channel string, samples array<float>"), length, step, 64.0)
    got = windows.chunk_slices(chunks_of(spark, channels, size), length, step, 64.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select(*got.columns).collect()))


@pytest.mark.parametrize("method", ["nlms", "rls", "kalman"])
def test_adaptive_chunks_equal_one_pass(method):
    x = np.random.default_rng(1).normal(size=900)
    p = config.method_params(method)
    whole, parts = adaptive.start(method, p), adaptive.start(method, p)
    one = adaptive.process(method, p, whole, x, 64.0)
    cut = np.concatenate([adaptive.process(method, p, parts, c, 64.0) for c in np.split(x, [100, 333, 700])])
    assert (one == cut).all()


def test_nlms_learns_an_autoregression():
    rng = np.random.default_rng(0)
    x = np.zeros(20000)
    e = rng.normal(size=len(x))
    for i in range(2, len(x)):
        x[i] = 1.5 * x[i - 1] - 0.75 * x[i - 2] + e[i]
    p = config.method_params("nlms", {"length": 2, "mu": 0.005})
    s = adaptive.start("nlms", p)
    out = adaptive.process("nlms", p, s, x, 256)
    assert s["weights"][0] == pytest.approx([1.5, -0.75], abs=0.08) and out[10000:].var() == pytest.approx(1, abs=0.12)


@pytest.mark.parametrize("rms", [5, 50, 500])
def test_gain_tracks_amplitude(rms):
    x = np.random.default_rng(2).normal(size=256 * 200) * rms
    p = config.method_params("kalman")
    y = adaptive.process("kalman", p, adaptive.start("kalman", p), x, 256)
    assert y[256 * 20 :].std() == pytest.approx(1, abs=0.04)


def test_adaptive_run_carries_state_and_stops_after_a_failure(spark):
    x = np.random.default_rng(3).normal(size=300)
    rows = [("c", "A", f"f{i}", i, 0, x[100 * i : 100 * i + 100].tolist()) for i in range(3)] + [("d", "A", "g0", 0, 0, [float("nan")] * 5), ("d", "A", "g1", 1, 0, [1.0] * 5)]
    df = spark.createDataFrame(rows, "case string, channel string, file string, file_order int, chunk_idx int, samples array<double>")
    got = {r["file"]: r for r in adaptive.run(df, "nlms", warm_start_s=0.0).collect()}
    p = config.method_params("nlms")
    want = adaptive.process("nlms", p, adaptive.start("nlms", p), x, 256)
    assert np.concatenate([got[f"f{i}"]["samples"] for i in range(3)]) == pytest.approx(want, abs=1e-6)
    assert (got["g0"]["status"], got["g1"]["status"]) == ("failed", "not_run")


@pytest.mark.parametrize("method", ["nlms", "rls", "kalman"])
def test_channels_side_by_side_are_independent(method):
    x = np.random.default_rng(7).normal(size=(3, 500)) * np.array([[1.0], [0.0], [40.0]])
    p = config.method_params(method)
    both = adaptive.process(method, p, adaptive.start(method, p, 3), x, 64.0)
    for c in range(3):
        assert adaptive.process(method, p, adaptive.start(method, p), x[c], 64.0) == pytest.approx(both[c], rel=1e-5, abs=1e-5)


def test_recursive_least_squares_is_ridge_regression():
    x = np.random.default_rng(8).normal(size=400)
    p = config.method_params("rls", {"length": 3, "forgetting": 1.0, "cap_factor": 1e9})
    s = adaptive.start("rls", p)
    adaptive.process("rls", p, s, x, 64.0)
    past = np.stack([np.concatenate([np.zeros(k + 1), x[: len(x) - k - 1]]) for k in range(3)], axis=1)[1:]
    assert s["weights"][0] == pytest.approx(np.linalg.solve(past.T @ past + np.eye(3), past.T @ x[1:]), abs=1e-8)


@pytest.mark.parametrize("method", ["nlms", "rls", "kalman"])
def test_adaptive_run_resumes_from_a_state(spark, method):
    x = np.random.default_rng(6).normal(size=400)
    rows = [("c", "A", f"f{i}", i, 0, x[100 * i : 100 * i + 100].tolist()) for i in range(4)]
    df = spark.createDataFrame(rows, "case string, channel string, file string, file_order int, chunk_idx int, samples array<double>")
    samples = lambda out: {r["file"]: list(r["samples"]) for r in out.collect()}
    options = {"fs": 64.0, "warm_start_s": 1.0}
    whole = samples(adaptive.run(df, method, **options))
    first = adaptive.run(df.where("file_order < 2"), method, **options)
    later = samples(adaptive.run(df.where("file_order >= 2"), method, **options, initial=adaptive.states(first, method, warm_start_s=1.0)))
    assert later == {f: whole[f] for f in ("f2", "f3")}


def test_settings():
    assert config.tag("nlms") == "nlms_L16_mu0.005" and config.tag("rls", {"delta": 5}) == "rls_L8_lam0.9999_delta5"
    assert config.tag("kalman", warm_start_s=600) == "kalman_qr0.0001_blk1_ws600"
    assert len(config.grid()) == 20 and len(config.feature_names()) == 32
    assert config.window_samples(config.DEFAULTS) == (1024, 512)
    with pytest.raises(ValueError):
        config.load(overrides={"segmentation": {"overlap": 1.0}})
    with pytest.raises(ValueError):
        config.method_params("nlms", {"x": 1})


def test_annotations(spark, tmp_path):
    (tmp_path / "c1").mkdir()
    text = "Data Sampling Rate: 256 Hz\n\nFile Name: c1_01.edf\nFile Start Time: 23:59:30\nFile End Time: 00:00:30\nNumber of Seizures in File: 0\n\nFile Name: c1_02.edf\nFile Start Time: 24:10:00\nFile End Time: 25:10:00\nNumber of Seizures in File: 2\nSeizure 1 Start Time: 9081 seconds\nSeizure 1 End Time: 9196 seconds\nSeizure 2 Start Time: 7804 seconds\nSeizure 2 End Time: 7853 seconds\nFile Name: c1_03.edf\nNumber of Seizures in File: 2\nSeizure Start Time: 10 seconds\nSeizure End Time: 5 seconds\n"
    (tmp_path / "c1" / "c1-summary.txt").write_text(text)
    parsed = annotations.blocks(annotations.read_texts(spark, str(tmp_path)))
    assert [(r["seizure_idx"], r["seizure_start_s"]) for r in annotations.build(parsed).orderBy("seizure_idx").collect()] == [(0, 7804.0), (1, 9081.0)]
    assert {r["file"]: r["duration_s"] for r in annotations.durations(parsed).collect()} == {"c1_01.edf": 60.0, "c1_02.edf": 3600.0, "c1_03.edf": None}
    assert [r["file"] for r in annotations.problems(parsed).collect()] == ["c1_03.edf"]


def test_edf_round_trip(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(3, 64 * 10)) * 50
    (tmp_path / "c1").mkdir()
    edf.write(str(tmp_path / "c1" / "c1_01.edf"), ["A", "B-0", "Z"], x, 64)
    (tmp_path / "c1" / "c1_02.edf").write_bytes(b"no header")
    edf.register(spark)
    head = {r["file"]: r for r in spark.read.format("edf").option("mode", "header").load(str(tmp_path)).collect()}
    assert head["c1_01.edf"]["n_samples"] == 640 and head["c1_01.edf"]["sfreq"] == 64.0 and head["c1_02.edf"]["error"]
    rows = spark.read.format("edf").option("channels", "Z,B").option("chunk_s", 4).load(str(tmp_path / "c1" / "c1_01.edf")).orderBy("channel", "chunk_idx").collect()
    assert [(r["channel"], r["chunk_idx"], r["start_sample"], len(r["samples"])) for r in rows] == [("B", 0, 0, 256), ("B", 1, 256, 256), ("B", 2, 512, 128), ("Z", 0, 0, 256), ("Z", 1, 256, 256), ("Z", 2, 512, 128)]
    assert np.concatenate([r["samples"] for r in rows if r["channel"] == "Z"]) == pytest.approx(x[2], abs=0.01)
    for path in (tmp_path.as_uri() + "/c1/c1_01.edf", f"{tmp_path}/c?/*_01.edf", f"{tmp_path}/**/c1_0[1].edf", f"{tmp_path}/c1"):
        parts = spark.read.format("edf").option("channels", "Z,B").option("chunk_s", 4).option("split_mb", 0.001).option("unusable", "skip").load(path)
        assert parts.rdd.getNumPartitions() > 3 and parts.orderBy("channel", "chunk_idx").collect() == rows
    assert spark.read.format("edf").load(f"{tmp_path}/none*").count() == 0


def test_tables(spark, tmp_path):
    (tmp_path / "RECORDS").write_text("c1/c1_01.edf\n\n c2/c2_01.edf \n")
    assert {tuple(r) for r in tables.read_records(spark, str(tmp_path / "RECORDS")).collect()} == {("c1", "c1_01.edf"), ("c2", "c2_01.edf")}
    (tmp_path / "per_patient_raw__rf__x.csv").write_text("patient,auc\np,0.5\n")
    r = tables.read_per_patient(spark, str(tmp_path), "patient string, auc double").first()
    assert (r["arm"], r["model"]) == ("raw", "rf__x")
    old = spark.createDataFrame([("p", 1), ("q", 1)], "patient string, file_order int")
    path = str(tmp_path / "t")
    tables.upsert_patients(spark, old, path)
    tables.upsert_patients(spark, old.where("patient = 'q'").withColumn("file_order", F.lit(9)), path)
    assert {tuple(r) for r in tables.current(spark, path).collect()} == {("p", 1), ("q", 9)}
    assert schemas.problems(old, "patient string, file_order long, x int") == ["type:file_order:int<>bigint", "missing:x"]


def test_a_run_that_stops_before_the_swap_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("p", 1)], "patient string, file_order int")
    with pytest.raises(FileNotFoundError):
        tables.current(spark, path)
    tables.upsert_patients(spark, one, path)
    reading = tables.current(spark, path)

    def stop(*_):
        raise KeyboardInterrupt

    swap = tables._swap
    monkeypatch.setattr(tables, "_swap", stop)
    with pytest.raises(KeyboardInterrupt):
        tables.upsert_patients(spark, one.withColumn("file_order", F.lit(2)), path)
    assert [tuple(r) for r in tables.current(spark, path).collect()] == [("p", 1)]
    monkeypatch.setattr(tables, "_swap", swap)
    tables.upsert_patients(spark, one.withColumn("file_order", F.lit(3)), path)
    assert [tuple(r) for r in tables.current(spark, path).collect()] == [("p", 3)]
    assert [tuple(r) for r in reading.collect()] == [("p", 1)]
    tables.upsert_patients(spark, one, path)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version-")]) == 2


def test_medians_by_counts(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 501), ("d", 500)) for v in rng.integers(0, 40, n)] + [("a", None), ("b", float("nan")), ("e", None)]
    got = {r["g"]: r["median"] for r in metrics.medians(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got == {g: float(np.median([v for k, v in rows if k == g and v is not None and not np.isnan(v)])) for g in "abcd"}


def test_missing_values_count_as_the_median(spark):
    rng = np.random.default_rng(1)
    rows = [("p", int(i % 3 == 0), f, float(v) if i % 7 else (None if i % 2 else float("nan"))) for f in ("x", "y") for i, v in enumerate(rng.normal(size=90))]
    rows = [r if r[2] == "x" else (*r[:3], 1.0) for r in rows]
    got = {r["feature"]: r["auc"] for r in direction.feature_auc(spark.createDataFrame(rows, "patient string, label int, feature string, value double"), 3).collect()}
    x = np.array([np.nan if r[3] is None else r[3] for r in rows if r[2] == "x"])
    x, y = np.where(np.isnan(x), np.nanmedian(x), x), np.array([r[1] for r in rows if r[2] == "x"])
    want = np.mean([(a > b) + 0.5 * (a == b) for a in x[y == 1] for b in x[y == 0]])
    assert got == {"x": pytest.approx(want), "y": 0.5}


def test_consensus_over_ranges(spark, monkeypatch):
    rng = np.random.default_rng(3)
    aucs = spark.createDataFrame([(f"p{i}", f, float(rng.integers(0, 9)) / 9 if i % 4 else None) for i in range(21) for f in "xyz"], "patient string, feature string, auc double")
    found = lambda: sorted(map(tuple, direction.consensus(aucs).collect()))
    alone = found()
    monkeypatch.setattr(direction, "RANKED_ALONE", 3)
    assert found() == alone
    against = direction.against_others(aucs, "p5", 2).collect()
    assert len(against) == 2 and all(r["flipped"] == ((r["focus"] - 0.5) * (r["consensus"] - 0.5) < 0) for r in against)


def test_folds_over_long_arrays_by_a_plain_loop(spark):
    n = 3 * arrays.BLOCK + 7
    at = sorted(int(v) for v in np.random.default_rng(2).integers(0, 40 * n, n))
    df = spark.createDataFrame([("r", a, a + 1) for a in at] + [("one", 5, 6)], "file string, raise_sample long, end_sample long")
    want, last = [], None
    for a in at:
        if last is None or a - last >= 60:
            want.append(a)
            last = a
    got = [r["raise_sample"] for r in events.refractory_alarms(df, ["file"], 60).where("file = 'r'").orderBy("raise_sample").collect()]
    assert got == want and len(want) > arrays.BLOCK
    z = [float(v) for v in np.random.default_rng(3).normal(size=n)]
    s, p, line = z[0], 1.0, [z[0]]
    for v in z[1:]:
        k = (p + 0.1) / (p + 0.1 + 1.0)
        s, p = s + k * (v - s), (1 - k) * (p + 0.1)
        line.append(s)
    assert spark.createDataFrame([(z,)], "z array<double>").select(adaptive.tracked(F.col("z"), 0.1)).first()[0] == pytest.approx(line)


def test_screening_features_by_plain_formulas():
    x = np.random.default_rng(7).normal(size=(3, 128)).cumsum(axis=1)
    got = kernels.screening_features(x, 64.0)
    assert got.shape == (3, 15)
    for row, w in zip(got, x, strict=True):
        energy = [abs(sum(v * 0.5 * (1 - np.cos(2 * np.pi * i / 127)) * np.exp(-2j * np.pi * k * i / 128) for i, v in enumerate(w))) ** 2 for k in range(65)]
        bands = [sum(e for k, e in enumerate(energy) if a <= k / 2 < b) for a, b in config.BANDS.values()]
        share = np.array([e for k, e in enumerate(energy) if 0.5 <= k / 2 <= 45])
        share = share / share.sum()
        d, dd = np.diff(w), np.diff(w, 2)
        mobility = np.sqrt(d.var() / w.var())
        want = [np.log(w.var()), np.log(abs(d).mean()), *np.log(bands), *(b / sum(bands) for b in bands), -(share * np.log(share)).sum(), mobility, np.sqrt(dd.var() / d.var()) / mobility]
        assert row.tolist() == pytest.approx(want, rel=1e-6)


def test_feature_table(spark):
    rng = np.random.default_rng(5)
    rows = [("w0", c, rng.normal(size=256).tolist()) for c in ("A", "B")] + [("w1", c, [3.0] * 256) for c in ("A", "B")]
    df = features.with_features(spark.createDataFrame(rows, "window string, channel string, x array<double>"), 256.0)
    assert {r["n_non_finite"] for r in df.where("window = 'w1'").collect()} == {2}
    wide = features.wide(df, ["window"], ["A", "B"])
    assert wide.columns == ["window", *config.feature_columns(["A", "B"])] and wide.count() == 2
    rows, seen = features.counted(df)
    rows.write.format("noop").mode("overwrite").save()
    assert features.share_non_finite(seen.get["replaced"], seen.get["n"], 32) == {"replaced": 4, "values": 128, "warn": True}


def test_held_out_chooser(spark):
    from wavemill.plans import loso

    rows = spark.createDataFrame([(p,) for p in "cab"], "patient string")
    assert loso.held_out(rows, 2) == ["a", "b"]
    assert {tuple(loso.held_out(rows, 2, s)) for s in range(20)} > {("a", "b")} and loso.held_out(rows, 2, 1) == loso.held_out(rows, 2, 1)


def test_bootstrap_weights_of_a_patient_are_drawn_once_for_all_groups(spark, monkeypatch):
    drawn, digest = spark.sparkContext.accumulator(0), compare.blake2b
    monkeypatch.setattr(compare, "blake2b", lambda *a, **o: drawn.add(1) or digest(*a, **o))
    rows = [("m", arm, "raw", "all", metric, p, float((p * k) % 7)) for arm in ("a", "b") for k, metric in enumerate(("auc", "f1", "sensitivity")) for p in range(40)]
    diffs = spark.createDataFrame(rows, "model string, arm string, reference string, subset string, metric string, patient long, _d double").repartition(6, "arm", "metric")
    got = compare._intervals(diffs, 200, 0).collect()
    assert drawn.value == 40 and len(got) == 6
    assert all((r["ci_low"], r["ci_high"]) == (0, 0) if r["metric"] == "auc" else r["ci_low"] < 3 < r["ci_high"] for r in got)


def test_entropies_and_sums_of_windows_side_by_side(spark):
    rng = np.random.default_rng(4)
    for n in (5, 6, 7, 64, 301):
        x = np.vstack([rng.normal(size=(40, n)), np.ones((1, n)), np.full((1, n), np.nan)])
        want = []
        for row in x[:, ::2]:
            r, k = 0.2 * row.std(), len(row)
            if not r > 0 or k <= 3:
                want.append((np.nan, np.nan))
                continue
            same = lambda i, j, m: bool(np.all(np.abs(row[i : i + m] - row[j : j + m]) <= r))  # noqa: E731, B023
            counts = [np.array([sum(same(i, j, m) for j in range(k - m + 1)) for i in range(k - m + 1)]) for m in (2, 3)]
            b = sum(same(i, j, 2) for i in range(k - 2) for j in range(k - 2)) - (k - 2)
            a = counts[1].sum() - (k - 2)
            want.append((-np.log(a / b) if a > 0 and b > 0 else np.nan, np.log(counts[0] / (k - 1)).mean() - np.log(counts[1] / (k - 2)).mean()))
        assert np.allclose(kernels.entropies(x), want, rtol=1e-12, atol=1e-12, equal_nan=True)
    x = rng.normal(size=(20, 64))
    s = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").select(time_domain.summary(F.col("x")).alias("s")).select("s.of.*", "s.line_length", "s.d1", "s.d2")
    assert [tuple(r) for r in s.collect()] == [tuple(v) for v in kernels.time_domain_summary(x).tolist()]


def test_tasks_of_windows_are_not_merged_by_their_bytes(spark):
    rows = [("c", "f", "A", i, 8 * i, [float(j) for j in range(8)]) for i in range(64)]
    df = spark.createDataFrame(rows, "case string, file string, channel string, chunk_idx int, start_sample int, samples array<double>")
    assert windows.chunk_slices(df, 16, 4, 8.0, least=8).rdd.getNumPartitions() >= 4
