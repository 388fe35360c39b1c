"""Held-out evaluation: folds, training rows, machines and forests against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import forest, kernel_machine
from wavemill.operators import sampling
from wavemill.plans import folds, loso


def table(spark, patients, n=60, width=6, seed=0, lift=1.5):
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(patients):
        for i in range(n + 5 * p):
            y = int(i % 4 == 0)
            x = rng.normal(size=width)
            x[0] += lift * y
            x[1] *= 100
            rows.append((f"p{p}", f"p{p}", "f", i, y, *[float(v) for v in x]))
    names = [f"f_{j}" for j in range(width)]
    return spark.createDataFrame(rows, "patient string, case string, file string, start_sample long, label int, " + ", ".join(f"{c} double" for c in names)), names


def test_group_folds_by_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    for people, splits in ((1, 3), (2, 3), (3, 3), (17, 3), (17, 5)):
        counts = [(f"p{i:02d}", int(rng.integers(1, 9))) for i in range(people)]
        load, want = [0] * min(splits, people), {}
        for p, n in sorted(counts, key=lambda c: (c[1], c[0]), reverse=True):
            want[p] = load.index(min(load))
            load[want[p]] += n
        got = folds.group_folds(spark.createDataFrame(counts, "patient string, n long"), splits).collect()
        assert {r["patient"]: r["split"] for r in got} == want and {r["n_splits"] for r in got} == {len(load)}
    several = spark.createDataFrame([(f, f"p{i}", i + f) for f in range(3) for i in range(1 + f)], "fold int, patient string, n long")
    assert {(r["fold"], r["n_splits"]) for r in folds.group_folds(several, 3, ("fold",)).collect()} == {(0, 1), (1, 2), (2, 3)}


def shared(counts, target, floor=0):
    total = sum(counts.values())
    target = min(max(target, 0), total)
    if target >= total:
        return dict(counts)
    raw = {p: n / total * target for p, n in counts.items()}
    base = {p: max(math.floor(raw[p]), min(floor, n)) for p, n in counts.items()}
    short = target - sum(base.values())
    for p in sorted((p for p in counts if counts[p] > base[p]), key=lambda p: (base[p] - raw[p], p))[: max(0, short)]:
        base[p] += 1
    return {p: min(b, counts[p]) for p, b in base.items()}


@pytest.mark.parametrize("most", [None, 60, 10])
def test_training_rows_of_all_folds(spark, most):
    sizes = {"a": (5, 40), "b": (1, 70), "c": (0, 9), "d": (12, 3), "e": (30, 200)}
    rows = [(p, p, "f", i + 1000 * y, y) for p, (n1, n0) in sizes.items() for y, n in ((1, n1), (0, n0)) for i in range(n)]
    df = spark.createDataFrame(rows, "patient string, case string, file string, start_sample long, label int")
    held = ["b", "e", "a"]
    got = folds.training(df, held, 3, loso.KEYS, ratio=2, most=most).collect()
    for f, out in enumerate(held):
        own = [r for r in got if r["fold"] == f]
        n1, n0 = ({p: v[k] for p, v in sizes.items() if p != out} for k in (0, 1))
        t1, asked = sum(n1.values()), min(round(2 * sum(n1.values())), sum(n0.values()))
        rest = shared(n0, asked)
        ictal = n1
        if most and t1 + asked > most:
            scale = most / (t1 + asked)
            ictal, rest = shared(n1, max(1, round(t1 * scale)), 1), shared(rest, max(0, round(asked * scale)))
        for y, want in ((1, ictal), (0, rest)):
            assert {p: sum(r["patient"] == p and r["label"] == y for r in own) for p in want} == want
        assert len({(r["patient"], r["start_sample"]) for r in own}) == len(own)


def test_training_without_seizures_and_of_large_patients(spark, monkeypatch):
    df = spark.createDataFrame([(p, p, "f", i, 0) for p in "abc" for i in range(20)], "patient string, case string, file string, start_sample long, label int")
    assert folds.training(df, ["a"], 0, loso.KEYS, most=5).count() == 40
    df, _ = table(spark, 3)
    take = lambda: sorted(tuple(r) for r in folds.training(df, ["p0", "p2"], 1, loso.KEYS, 2, 50).select("fold", "patient", "start_sample").collect())
    alone = take()
    monkeypatch.setattr(folds, "RANKED_ALONE", 0)
    assert take() == alone  # ranked over range partitions


def test_allocation_has_no_single_partition_exchange(spark):
    counts = spark.range(1000).select(F.col("id").alias("patient"), (F.col("id") % 17 + 1).alias("n"))
    got = {r["patient"]: r["alloc"] for r in sampling.allocation(counts, F.lit(2500), 1).collect()}
    assert got == shared({i: i % 17 + 1 for i in range(1000)}, 2500, 1)
    ranked = sampling.allocation(counts, F.lit(2500))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    below = [p.split("\n")[1:3] for p in plan.split("Exchange SinglePartition")[1:]]
    assert all(any("partial_" in line for line in lines) for lines in below)  # a sum of each task, never rows


def plain_machine(x, y, cost, gamma, steps=60):
    """The same objective over one coefficient for each row, by Newton's steps on the whole kernel."""
    k = np.array([[math.exp(-gamma * sum((a - b) ** 2 for a, b in zip(u, v, strict=True))) for v in x] for u in x])
    z = np.hstack([k, np.ones((len(x), 1))])
    free = np.zeros((len(x) + 1, len(x) + 1))
    free[:-1, :-1] = k + 1e-9 * np.eye(len(x))
    w = np.zeros(len(x) + 1)
    for _ in range(steps):
        lacks = 1 - y * (z @ w)
        a = lacks > 0
        g = free @ w - 2 * z[a].T @ (cost[a] * y[a] * lacks[a])
        h = free + 2 * (z[a].T * cost[a]) @ z[a] + 1e-12 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return z @ w, w


def test_machine_against_plain_kernel_loops(spark):
    df, names = table(spark, 4, n=62, seed=4)
    got = {(r["patient"], r["start_sample"]): r["y_score"] for r in loso.predict(df, names, "svm", ["p3"], ratio=100, most=None).collect()}
    rows = df.collect()
    train = [r for r in rows if r["patient"] != "p3"]
    x = np.array([[np.float32(r[c]) for c in names] for r in train], float)
    y = np.array([1.0 if r["label"] else -1.0 for r in train])
    mean, sd = x.mean(0), x.std(0)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    scaled, gamma = (x - mean) / sd, 1 / 6
    assert len(x) < loso.LANDMARKS  # every row is a landmark: the features are the kernel itself
    _, w = plain_machine(scaled, y, cost, gamma)
    test = [r for r in rows if r["patient"] == "p3"]
    t = (np.array([[np.float32(r[c]) for c in names] for r in test], float) - mean) / sd
    want = kernel_machine.rbf(t, scaled, gamma) @ w[:-1] + w[-1]
    mine = np.array([got["p3", r["start_sample"]] for r in test])
    rank = lambda v: np.argsort(np.argsort(v))
    assert len(got) == len(test) and np.corrcoef(rank(mine), rank(want))[0, 1] > 0.999
    assert np.abs(mine - want).max() < 0.02


def test_landmarks_of_many_rows_keep_the_order(spark, monkeypatch):
    df, names = table(spark, 3, n=150, seed=5)
    whole = {r["start_sample"]: r["y_score"] for r in loso.predict(df, names, "svm", ["p0"], ratio=100, most=None).collect()}
    monkeypatch.setattr(loso, "LANDMARKS", 120)
    few = {r["start_sample"]: r["y_score"] for r in loso.predict(df, names, "svm", ["p0"], ratio=100, most=None).collect()}
    rank = lambda v: np.argsort(np.argsort([v[k] for k in sorted(whole)]))
    assert np.corrcoef(rank(whole), rank(few))[0, 1] > 0.95


def test_shapes_choose_by_anova(spark):
    df, names = table(spark, 2, n=80, seed=2)
    rows = df.select(F.lit(0).alias("fold"), F.lit(-1).alias("split"), "label", F.array(*[F.col(c).cast("float") for c in names], F.lit(1.0).cast("float")).alias("x")).repartition(5)
    got = loso.shapes(rows, 3).first()
    x = np.array([[*map(np.float32, (r[c] for c in names)), 1] for r in df.collect()], float)
    y = np.array([r["label"] for r in df.collect()])
    a, b = x[y == 1], x[y == 0]
    between = len(a) * (a.mean(0) - x.mean(0)) ** 2 + len(b) * (b.mean(0) - x.mean(0)) ** 2
    within = ((a - a.mean(0)) ** 2).sum(0) + ((b - b.mean(0)) ** 2).sum(0)
    best = sorted(np.argsort(-(between[:6] / within[:6]))[:3])
    assert np.frombuffer(got["chosen"], np.int32).tolist() == best
    assert np.frombuffer(got["mean"]) == pytest.approx(x.mean(0)[best]) and np.frombuffer(got["scale"]) == pytest.approx(x.std(0)[best])
    assert (got["n"], got["n1"]) == (len(y), int(y.sum()))


def test_bags_and_their_weights_by_plain_loops():
    rows, y = np.arange(2000), np.arange(2000) % 5 // 4
    times = forest.bag(7, 3, rows)
    mask = 2**64 - 1

    def scrambled(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    for i in range(0, 2000, 97):
        u = (scrambled(scrambled(7 + 0x9E3779B97F4A7C15 * 4 & mask) ^ i) >> 11) / 2**53
        p, k = math.exp(-1), 0
        while u > p:
            k += 1
            p += math.exp(-1) / math.factorial(k)
        assert times[i] == k
    assert abs(times.mean() - 1) < 0.1 and abs((times == 0).mean() - math.exp(-1)) < 0.05
    weights = forest.bag_weights(times, y)
    n = [sum(int(t) for t, c in zip(times, y, strict=True) if c == k) for k in (0, 1)]
    assert weights.tolist() == pytest.approx([t * sum(n) / (2 * n[c]) for t, c in zip(times, y, strict=True)])
    assert weights[y == 0].sum() == pytest.approx(weights[y == 1].sum())
    assert forest.bag_weights(np.array([1, 2]), np.array([0, 0])).tolist() == [0.5, 1.0]


def test_trees_divide_until_leaves_are_pure_and_obey_their_limits():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    borders = forest.borders(x)
    bins = forest.binned(x, borders)
    assert all((x[:, j] <= np.append(borders[j], np.inf)[bins[:, j]]).all() for j in range(5))
    grow = lambda depth, leaf: forest.grow(bins, y, np.ones(400), depth, leaf, np.random.default_rng(1))
    whole = grow(None, 1)
    assert set(whole["share"][whole["feature"] < 0]) <= {0.0, 1.0} and (np.round(forest.score(whole, bins)) == y).mean() > 0.97
    assert len(grow(1, 1)["feature"]) == 3 and len(grow(0, 1)["feature"]) == 1
    large = grow(None, 40)
    assert min(np.unique(forest.score(large, bins), return_counts=True)[1]) >= 40
    alone = forest.grow(bins, np.zeros(400, int), np.ones(400), None, 1, np.random.default_rng(1))
    assert alone["feature"].tolist() == [-1] and alone["share"].tolist() == [0.0]
    # a node takes the best of all cuts of the features it looks at
    one = forest.grow(bins[:, :1], y, np.ones(400), 1, 1, np.random.default_rng(1))
    gini = lambda v: 2 * v.mean() * (1 - v.mean()) * len(v) if len(v) else 0.0
    costs = [gini(y[bins[:, 0] <= c]) + gini(y[bins[:, 0] > c]) for c in range(63)]
    assert costs[one["cut"][0]] == pytest.approx(min(costs))


@pytest.mark.parametrize("people", [2, 3, 4])
def test_nested_tuning_with_few_patients(spark, people):
    df, names = table(spark, people, n=40, width=3, seed=people)
    held = [f"p{i}" for i in range(people)]
    chosen = []
    got = loso.predict(df, names, "svm", held, grid={"C": [0.001, 10], "gamma": ["scale"]}, fixed={"C": 2.0}, chosen=chosen)
    assert got.count() == df.count() and [p for p, _ in chosen] == held
    assert {s["C"] for _, s in chosen} <= ({2.0} if people == 2 else {0.001, 10})  # one training patient cannot be split


def test_nested_tuning_takes_what_validates_better(spark):
    df, names = table(spark, 4, n=120, width=4, seed=8, lift=2.0)
    chosen = []
    grid = {"n_estimators": [20], "max_depth": [0, None], "min_samples_leaf": [1]}
    got = loso.predict(df, names, "rf", ["p0", "p2"], grid=grid, chosen=chosen)
    assert [s["max_depth"] for _, s in chosen] == [None, None]  # a tree without any split ranks nothing
    assert got.select(F.avg((F.col("y_pred") == F.col("y_true")).cast("int"))).first()[0] > 0.75
    with pytest.raises(ValueError, match="unknown parameters"):
        loso.predict(df, names, "svm", ["p0"], grid={"c": [1]})
    with pytest.raises(ValueError, match="unknown model"):
        loso.predict(df, names, "tree", ["p0"])


def test_calibration_rows_take_no_part(spark):
    df, names = table(spark, 3, n=40, width=3)
    marked = df.withColumn("is_calibration", F.col("start_sample") < 10)
    got = loso.predict(marked, names, "rf", ["p1"], fixed={"n_estimators": 5})
    assert got.agg(F.min("start_sample"), F.count(F.lit(1))).first() == (10, 35)


@pytest.mark.parametrize("kind", ["svm", "rf"])
def test_jobs_do_not_grow_with_patients(spark, kind):
    def jobs(people):
        df, names = table(spark, people, n=16, width=3)
        group = f"{kind}-{people}"
        held = [f"p{i}" for i in range(people)]
        spark.sparkContext.setJobGroup(group, group)
        try:
            scored = loso.predict(df, names, kind, held, fixed={"n_estimators": 3} if kind == "rf" else None)
            assert scored.select("patient").distinct().count() == people
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        assert found > 10
        return found

    few, many = jobs(4), jobs(40)
    assert abs(many - few) <= 12  # machines may take a step more or less; re-planning splits jobs
