"""Leave-one-patient-out evaluation, all folds side by side.

The training rows of all folds are one table (``folds.training``); a *set* is what
one model is fitted on: a fold's rows, or for tuning those of a fold without
the patients of one inner split. Every step below is one pass over all sets:

* ``shapes``: means, spreads and ANOVA F of the features, added up where the rows lie; the best ``k`` features are chosen.
* An RBF machine: landmarks of each set become Nyström features; Newton's steps on the squared hinge need a gradient and a
  Hessian per model, added up where the rows lie, so a step is one grouping for all models.
* A forest: a set's chosen features are binned and packed into one row (a byte a value; the number of training windows is a
  setting); trees are grown in tasks, a few to a task, on bags that follow from seed, tree and row.

Models stay in tables and meet the rows that they score by set. The driver holds the
weights of the machines while they are fitted, a few hundred numbers each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import forest, kernel_machine
from ..operators import leakage, metrics, sampling
from ..shared import discard, kept, partitions
from . import folds
from .bindings import windows_of_vectors

KEYS = ["case", "file", "start_sample"]
SET = ["fold", "split"]
#: The split of a fold's whole training rows.
WHOLE = -1
#: Rows of a set that meet a model in one task.
AT_ONCE = 8192
LANDMARKS = 256
STEPS = 9
TREES_AT_ONCE = 8
# The parameters of both models, and what they are where a setting says nothing.
USUAL = {"svm": {"C": 1.0, "gamma": "scale"}, "rf": {"n_estimators": 200, "max_depth": None, "min_samples_leaf": 1}}


def points(kind: str, grid: dict[str, list] | None, fixed: dict | None = None) -> list[dict]:
    """The settings of a grid in order of its names (the last one changes fastest); without a grid the fixed one."""
    if kind not in USUAL:
        raise ValueError(f"unknown model {kind}")
    if unknown := ({*(grid or {})} | {*(fixed or {})}) - {*USUAL[kind]}:
        raise ValueError(f"unknown parameters of {kind}: {sorted(unknown)}")
    base = USUAL[kind] | (fixed or {})
    names = sorted(grid or {})
    return [base | dict(zip(names, v, strict=True)) for v in product(*[grid[n] for n in names])] if names else [base]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _groups(b: pa.RecordBatch | pa.Table, *names: str) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """The rows of a batch by some columns of whole numbers."""
    keys, at = np.unique(np.stack([b.column(c).to_numpy() for c in names], axis=1), axis=0, return_inverse=True)
    for i, key in enumerate(keys):
        yield tuple(int(v) for v in key), np.flatnonzero(at.reshape(-1) == i)


def _blobs(z: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes."""
    return pa.Array.from_buffers(pa.binary(8 * z.shape[1]), len(z), [None, pa.py_buffer(np.ascontiguousarray(z))]).cast(pa.binary())


def _read(b: bytes, kind: type = float) -> np.ndarray:
    return np.frombuffer(b, kind)


# shapes ---------------------------------------------------------------------

SHAPE = "fold int, split int, n long, n1 long, chosen binary, mean binary, scale binary"


def _merged(a: tuple, b: tuple) -> tuple:
    """Count, mean and sum of squared deviations of two groups of rows together."""
    n = a[0] + b[0]
    if not n:
        return a
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + step**2 * (a[0] * b[0] / n)


def shapes(rows: DataFrame, k: int) -> DataFrame:
    """Per set: rows, ictal rows, and of the ``k`` features with the highest ANOVA F (ties: the first) place, mean and spread (0: constant)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"))
            for key, at in _groups(b, *SET, "label"):
                own = x[at]
                got = (len(own), own.mean(0), ((own - own.mean(0)) ** 2).sum(0))
                found[key] = _merged(found[key], got) if key in found else got
        if found:
            columns = list(zip(*[(*key, n, m.tobytes(), s.tobytes()) for key, (n, m, s) in found.items()], strict=True))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*SET, "label", "n", "mean", "squares"])

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        per = {}
        for r in rows.itertuples():
            got = (r.n, _read(r.mean), _read(r.squares))
            per[r.label] = _merged(per[r.label], got) if r.label in per else got
        n, mean, squares = reduce(_merged, per.values())
        within = sum(v[2] for v in per.values())
        between = sum(v[0] * (v[1] - mean) ** 2 for v in per.values())
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.nan_to_num(between / within, nan=-1.0, posinf=np.inf)
        chosen = np.sort(np.argsort(-ratio, kind="stable")[:k])
        spread = np.sqrt(squares / n)[chosen]
        first = rows.iloc[0]
        return pd.DataFrame([(first["fold"], first["split"], n, per[1][0] if 1 in per else 0, chosen.astype(np.int32).tobytes(), mean[chosen].tobytes(), spread.tobytes())], columns=[c.split()[0] for c in SHAPE.split(", ")])

    parts = rows.select(*SET, "label", "x").mapInArrow(part, "fold int, split int, label int, n long, mean binary, squares binary")
    return parts.groupBy(*SET).applyInPandas(whole, SHAPE)  # a row for each task, set and class


def _beside(rows: DataFrame, models: DataFrame, salts: int, f: Callable, schema: str) -> DataFrame:
    """``f(rows, models)``, of Arrow tables, for at most about ``AT_ONCE`` rows of a set and all models of the set."""
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*KEYS), F.lit(salts)).cast("int"))
    copies = models.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [*SET, "_salt"]
    return spread.groupBy(*on).cogroup(copies.groupBy(*on)).applyInArrow(f, schema)


def _salts(n: int) -> int:
    return max(1, -(-n // AT_ONCE))


# machines -------------------------------------------------------------------


def _landmarks(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """The ``n`` rows of each set that come first in a seeded order; a task passes on no more than that of each set."""
    line = Window.partitionBy(*SET).orderBy("h", *KEYS)
    return rows.select(*SET, *KEYS, "x", F.xxhash64(F.lit(seed), *KEYS).alias("h")).withColumn("_r", F.row_number().over(line)).where(F.col("_r") <= n).select(*SET, "h", "x")


def _scaled(x: np.ndarray, chosen: np.ndarray, mean: bytes, scale: bytes) -> np.ndarray:
    """Chosen features without their mean, over their spread; constant ones stay 0."""
    spread = _read(scale)
    return (x[:, chosen] - _read(mean)) / np.where(spread > 0, spread, 1.0)


BASE = f"{SHAPE}, g int, gamma double, landmarks binary, project binary"


def _bases(landmarks: DataFrame, shape: DataFrame, gammas: list) -> DataFrame:
    """Per set and gamma: the landmarks scaled, and the projection to Nyström features."""

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        s = own.to_pylist()[0]
        chosen = _read(s["chosen"], np.int32)
        marks = _scaled(_matrix(rows.sort_by("h").column("x")), chosen, s["mean"], s["scale"])
        varied = int((_read(s["scale"]) > 0).sum())
        out = []
        for g, gamma in enumerate(gammas):
            # "scale": one over the number of features times the variance of all entries, which is the share of features that vary
            width = 1 / max(1, varied if gamma == "scale" else len(chosen)) if gamma in ("scale", "auto") else float(gamma)
            out.append(s | {"g": g, "gamma": width, "landmarks": marks.tobytes(), "project": kernel_machine.projection(marks, width).tobytes()})
        return pa.Table.from_pylist(out, schema=own.schema.append(pa.field("g", pa.int32())).append(pa.field("gamma", pa.float64())).append(pa.field("landmarks", pa.binary())).append(pa.field("project", pa.binary())))

    return landmarks.groupBy(*SET).cogroup(shape.groupBy(*SET)).applyInArrow(run, BASE)


def _features(x: np.ndarray, base: dict) -> np.ndarray:
    """Nyström features of raw rows."""
    chosen = _read(base["chosen"], np.int32)
    marks = _read(base["landmarks"]).reshape(-1, len(chosen))
    return kernel_machine.lift(_scaled(x, chosen, base["mean"], base["scale"]), marks, _read(base["project"]).reshape(len(marks), -1), base["gamma"])


def _at(w: np.ndarray | None, size: int) -> np.ndarray:
    return np.zeros(size) if w is None else w


def _added(costs: dict[tuple, list[float]], now: dict[tuple, np.ndarray | None]):
    """Loss, gradient and Hessian of a task's rows, a row for each machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            for key, at in _groups(b, "fold", "split", "g"):
                own = b.take(pa.array(at))
                z = np.frombuffer(b"".join(own.column("z").to_pylist()), float).reshape(len(at), -1)
                y, weight = own.column("y").to_numpy(), own.column("weight").to_numpy()
                for m in ((*key, c) for c in costs.get(key, ())):
                    if m in now:
                        got = kernel_machine.sums(z, y, m[3] * weight, _at(now[m], z.shape[1]))
                        total[m] = [a + b for a, b in zip(total[m], got, strict=True)] if m in total else list(got)
        if total:
            columns = list(zip(*[(*m, loss, g.tobytes(), h.tobytes()) for m, (loss, g, h) in total.items()], strict=True))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["fold", "split", "g", "c", "loss", "gradient", "hessian"])

    return run


def _stepped(now: dict[tuple, np.ndarray | None]):
    """Where a Newton step leads from the sums of all tasks."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        gradient = sum(_read(v) for v in rows["gradient"])
        hessian = sum(_read(v) for v in rows["hessian"]).reshape(len(gradient), -1)
        value, gain, w = kernel_machine.newton(float(rows["loss"].sum()), gradient, hessian, _at(now[key], len(gradient)))
        return pd.DataFrame([(*key, value, gain, w)], columns=["fold", "split", "g", "c", "value", "gain", "w"])

    return run


def _machines(rows: DataFrame, wanted: list[tuple[int, int, int, float]], bases: DataFrame, salts: int) -> dict[tuple[int, int, int, float], np.ndarray]:
    """Weights of the machines (fold, split, gamma, C): a pass over the lifted rows for each of at most ``STEPS`` Newton steps, whatever their number."""

    names = ["fold", "split", "g", "y", "weight", "z"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary()]

    def lift(rows: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows:
            x, ictal = _matrix(rows.column("x")), rows.column("label").to_numpy() == 1
            for base in own.to_pylist():
                n1 = int(base["n1"])
                weight = np.where(ictal, base["n"] / (2 * max(1, n1)), base["n"] / (2 * max(1, base["n"] - n1)))
                same = [pa.array(np.full(len(x), base[c], np.int32)) for c in names[:3]]
                out.append(pa.Table.from_arrays([*same, pa.array(np.where(ictal, 1.0, -1.0)), pa.array(weight), _blobs(_features(x, base))], names=names))
        return pa.concat_tables(out) if out else pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)

    lifted = kept(_beside(rows.select(*SET, *KEYS, "label", "x"), bases, salts, lift, "fold int, split int, g int, y double, weight double, z binary"))
    costs: dict[tuple, list[float]] = {}
    for f, s, g, c in wanted:
        costs.setdefault((f, s, g), []).append(c)
    at: dict[tuple, np.ndarray | None] = dict.fromkeys(wanted)
    best: dict[tuple, tuple[float, np.ndarray]] = {}
    open_ = set(wanted)
    for _ in range(STEPS):
        parts = lifted.mapInArrow(_added(costs, {m: at[m] for m in open_}), "fold int, split int, g int, c double, loss double, gradient binary, hessian binary")
        moved = parts.groupBy("fold", "split", "g", "c").applyInPandas(_stepped({m: at[m] for m in open_}), "fold int, split int, g int, c double, value double, gain double, w array<double>")
        for r in moved.collect():
            m = (r["fold"], r["split"], r["g"], r["c"])
            w = np.array(r["w"])
            here = _at(at[m], len(w))
            if m not in best or r["value"] <= best[m][0]:
                best[m] = (r["value"], here)
                at[m] = w
                if r["gain"] <= 1e-9 * (1 + r["value"]):
                    open_.discard(m)
            else:  # too far: half-way back
                at[m] = (best[m][1] + here) / 2
        if not open_:
            break
    discard(lifted)
    return {m: w for m, w in at.items() if w is not None}


# forests --------------------------------------------------------------------

PACK = f"{SHAPE}, labels binary, bins binary, borders array<array<double>>"


def _packs(rows: DataFrame, shape: DataFrame) -> DataFrame:
    """Per set one row: labels and binned chosen features of its rows in order of their keys."""

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        s = own.to_pylist()[0]
        rows = rows.sort_by([(c, "ascending") for c in KEYS])
        x = _matrix(rows.column("x"))[:, _read(s["chosen"], np.int32)]
        at = forest.borders(x)
        packed = {"labels": rows.column("label").to_numpy().astype(np.int8).tobytes(), "bins": forest.binned(x, at).tobytes(), "borders": [b.tolist() for b in at]}
        fields = [pa.field("labels", pa.binary()), pa.field("bins", pa.binary()), pa.field("borders", pa.list_(pa.list_(pa.float64())))]
        return pa.Table.from_pylist([s | packed], schema=pa.schema([*own.schema, *fields]))

    return rows.select(*SET, *KEYS, "label", "x").groupBy(*SET).cogroup(shape.groupBy(*SET)).applyInArrow(run, PACK)


TREE = "fold int, split int, p int, tree int, feature binary, cut binary, left binary, share binary"


def _forests(packs: DataFrame, wanted: list[tuple[int, int, int]], params: list[dict], seed: int) -> DataFrame:
    """Trees of the forests (fold, split, place of the parameters), ``TREES_AT_ONCE`` of them to a row of work."""
    spark = packs.sparkSession
    work = [(f, s, p, t) for f, s, p in wanted for t in range(0, params[p]["n_estimators"], TREES_AT_ONCE)]
    todo = spark.createDataFrame(work, "fold int, split int, p int, first int").join(packs, SET)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                y = _read(r.labels, np.int8).astype(int)
                bins, own, out = _read(r.bins, np.uint8).reshape(len(y), -1), params[r.p], []
                for t in range(r.first, min(r.first + TREES_AT_ONCE, own["n_estimators"])):
                    weight = forest.bag_weights(forest.bag(seed + r.fold, t, np.arange(len(y))), y)
                    tree = forest.grow(bins, y, weight, own["max_depth"], own["min_samples_leaf"], np.random.default_rng([seed + r.fold, r.split + 1, t]))
                    out.append((r.fold, r.split, r.p, t, *[tree[c].tobytes() for c in ("feature", "cut", "left", "share")]))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in TREE.split(", ")])

    return todo.repartition(max(partitions(spark), min(len(work), 4096)), *SET, "p", "first").mapInPandas(run, TREE)


# fitting and scoring --------------------------------------------------------

SCORED = "fold int, split int, p int, case {case}, file {file}, start_sample long, y_score double, y_pred int"


def _scored(kind: str, fit_rows: DataFrame, score_rows: DataFrame, wanted: list[tuple[int, int, int]], params: list[dict], k: int, seed: int, largest: int) -> DataFrame:
    """Scores of ``score_rows`` by the models (fold, split, place of the parameters), each fitted on the rows of its set."""
    spark = fit_rows.sparkSession
    shape = kept(shapes(fit_rows, k))
    n_most = shape.agg(F.max("n")).first()[0] or 0
    kinds = dict(score_rows.dtypes)
    schema = SCORED.format(**kinds)
    names = [c.split()[0] for c in schema.split(", ")]
    take = score_rows.select(*SET, *KEYS, "x")

    def told(rows: pa.Table, of: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        keys = rows.select([*SET, *KEYS])
        out = [keys.append_column("p", pa.array(np.full(len(score), p, np.int32))).append_column("y_score", pa.array(score, pa.float64())).append_column("y_pred", pa.array(pred.astype(np.int32))).select(names) for p, (score, pred) in of.items()]
        none = keys.slice(0, 0).append_column("p", pa.array([], pa.int32())).append_column("y_score", pa.array([], pa.float64())).append_column("y_pred", pa.array([], pa.int32())).select(names)
        return pa.concat_tables(out) if out and rows.num_rows else none

    if kind == "svm":
        gammas = list(dict.fromkeys(q["gamma"] for q in params))
        bases = kept(_bases(_landmarks(fit_rows, LANDMARKS, seed), shape, gammas))
        machine = lambda f, s, p: (f, s, gammas.index(params[p]["gamma"]), float(params[p]["C"]))
        weights = _machines(fit_rows, list(dict.fromkeys(machine(*m) for m in wanted)), bases, _salts(n_most))
        fitted = spark.createDataFrame([(*m, machine(*m)[2], weights[machine(*m)].tolist()) for m in wanted if machine(*m) in weights], "fold int, split int, p int, g int, w array<double>")

        def run(rows: pa.Table, own: pa.Table) -> pa.Table:
            x, of = _matrix(rows.column("x")), {}
            for base in own.to_pylist() if rows.num_rows else ():
                of[base["p"]] = (score := _features(x, base) @ np.asarray(base["w"])), score > 0
            return told(rows, of)

        models = bases.join(fitted, [*SET, "g"])
    else:
        packs = kept(_packs(fit_rows, shape))
        trees = kept(_forests(packs, wanted, params, seed))

        def run(rows: pa.Table, own: pa.Table) -> pa.Table:
            if not rows.num_rows or not own.num_rows:
                return told(rows, {})
            own = own.to_pandas()
            first = own[own["chosen"].notna()].iloc[0]
            bins, of = forest.binned(_matrix(rows.column("x"))[:, _read(first["chosen"], np.int32)], [np.asarray(b) for b in first["borders"]]), {}
            for p, some in own[own["chosen"].isna()].groupby("p"):
                total = np.zeros(len(bins))
                for t in some.sort_values("tree").itertuples():
                    total += forest.score({"feature": _read(t.feature, np.int32), "cut": _read(t.cut, np.int32), "left": _read(t.left, np.int32), "share": _read(t.share, np.float32)}, bins)
                of[int(p)] = (share := total / len(some)), share > 0.5
            return told(rows, of)

        models = trees.unionByName(packs.select(*SET, "chosen", "borders"), allowMissingColumns=True)
    return _beside(take, models, _salts(largest), run, schema)


def predict(rows: DataFrame, features: list[str], kind: str, held: list, seed: int = 0, shuffle: bool = False, grid: dict[str, list] | None = None, fixed: dict | None = None, splits: int = 3, k: int = 100, ratio: float = 5, most: int | None = 30_000, chosen: list | None = None) -> DataFrame:
    """Predictions for each held-out patient by a model of all others; calibration windows are neither trained on nor scored.

    With a ``grid`` of several settings each fold takes the one with the best mean AUC over
    inner splits of its training patients (``folds.group_folds``, at most ``splits``); folds
    with fewer than two training patients take ``fixed``. ``k`` features are selected, training rows
    balanced to ``ratio`` and ``most``. ``chosen``, if given, gets a row (held-out patient, setting) for each fold.
    The number of Spark jobs does not depend on the number of patients.
    """
    every = points(kind, grid, fixed)
    base = points(kind, None, fixed)[0]
    own = [*KEYS, F.col("label").cast("int").alias("label"), F.array(*[F.col(f).cast("float") for f in features]).alias("x")]
    usable = rows.where("not is_calibration") if "is_calibration" in rows.columns else rows
    usable = usable.select("patient", *own)
    k = min(k, len(features))
    train = kept(folds.training(usable, held, seed, KEYS, ratio, most).select("fold", "patient", *KEYS, "label", "x"))
    who = F.array(*[F.lit(p) for p in held])
    leakage.require_none(train.where(F.element_at(who, F.col("fold") + 1).eqNullSafe(F.col("patient"))), "held-out patients in training")
    if shuffle:
        train = kept(sampling.permuted_labels(train, seed, KEYS, ("fold",)))
    sizes = train.groupBy("fold", "patient").agg(F.count(F.lit(1)).alias("n"))
    setting = dict.fromkeys(range(len(held)), every[0] if len(every) == 1 and grid else base)
    if len(every) > 1:
        inner = kept(train.join(folds.group_folds(sizes, splits, ("fold",)).where("n_splits > 1").select("fold", "patient", F.col("split").alias("_in"), "n_splits"), ["fold", "patient"]))
        sets = [(r["fold"], s) for r in inner.groupBy("fold").agg(F.max("n_splits").alias("n")).collect() for s in range(r["n"])]
        others = inner.withColumn("split", F.explode(F.filter(F.sequence(F.lit(0), F.col("n_splits") - 1), lambda s: s != F.col("_in"))))
        judged = inner.withColumn("split", F.col("_in"))
        if sets:
            largest = judged.groupBy(*SET).count().agg(F.max("count")).first()[0]
            wanted = [(f, s, p) for f, s in sets for p in range(len(every))]
            tried = _scored(kind, others, judged, wanted, every, k, seed, largest)
            aucs = metrics.auc(tried.join(judged.select(*SET, *KEYS, "label"), [*SET, *KEYS]), [*SET, "p"], "label", "y_score")
            mean = aucs.groupBy("fold", "p").agg(F.avg("auc").alias("auc"))
            # an undefined mean is the lowest, ties go to the first setting of the grid
            for r in mean.groupBy("fold").agg(F.max_by("p", F.struct(F.coalesce(F.round("auc", 12), F.lit(-1.0)), -F.col("p"))).alias("p")).collect():
                setting[r["fold"]] = every[r["p"]]
    if chosen is not None:
        chosen += [(p, setting[i]) for i, p in enumerate(held)]
    params = [dict(t) for t in dict.fromkeys(tuple(sorted(q.items(), key=str)) for q in setting.values())]
    wanted = [(i, WHOLE, params.index(setting[i])) for i in range(len(held))]
    numbered = F.array_position(who, F.col("patient"))
    test = usable.withColumn("fold", (numbered - 1).cast("int")).where("fold >= 0").withColumn("split", F.lit(WHOLE))
    largest = test.groupBy("fold").count().agg(F.max("count")).first()[0] or 0
    scored = _scored(kind, train.withColumn("split", F.lit(WHOLE)), test, wanted, params, k, seed, largest)
    patient = F.element_at(who, F.col("fold") + 1)
    scored = scored.select(patient.alias("patient"), *KEYS, "y_score", "y_pred")
    return test.select("patient", *KEYS, F.col("label").alias("y_true")).join(scored, ["patient", *KEYS])


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Embeddings as feature rows of four patients."""
    names = [f"f{i}" for i in range(64)]
    rows = windows_of_vectors(spark, sf_dir).select((F.col("vec_id") % 4).alias("patient"), (F.col("vec_id") % 4).cast("string").alias("case"), F.lit("all").alias("file"), F.col("vec_id").alias("start_sample"), "label", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    return rows, names


def held_out(rows: DataFrame, most: int | None = None, seed: int | None = None) -> list:
    """All patients (or the first ``most``) in order, or with a seed in a pseudo-random order."""
    order = ["patient"] if seed is None else [sampling.seeded(seed, ["patient"]), "patient"]
    found = rows.select("patient").distinct().orderBy(*order)
    return [r[0] for r in (found if most is None else found.limit(most)).collect()]


def evaluate(table: tuple[DataFrame, list[str]], kind: str, patients: int | None = None, seed: int = 0, **options) -> DataFrame:
    """Window metrics of every patient, each held out once."""
    rows, names = table
    return metrics.window_metrics(kept(predict(rows, names, kind, held_out(rows, patients), seed, **options)), ["patient"], 2.0)


def shuffle_check(table: tuple[DataFrame, list[str]], kind: str, patients: int = 3, seed: int = 0, band: tuple[float, float] = (0.35, 0.65), **options) -> DataFrame:
    """AUC per patient with permuted training labels, and whether their mean is near chance."""
    rows, names = table
    got = metrics.auc(kept(predict(rows, names, kind, held_out(rows, patients, seed), seed, shuffle=True, **options)), ["patient"], "y_true", "y_score")
    mean = got.agg(F.avg("auc").alias("mean_auc"))
    return got.crossJoin(F.broadcast(mean)).withColumn("passes", F.col("mean_auc").between(*band))
