"""``python -m wavemill ENTRY ROOT [--config FILE] [--patients A,B] [options]``"""

from __future__ import annotations

import argparse
import ast

from pyspark.sql import DataFrame, SparkSession

from . import config, session
from .operators import cohort
from .plans import entries
from .shared import clear


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wavemill", description=__doc__)
    p.add_argument("entry", choices=["index", "preprocess", "adapt", "windows", "features", "baseline", "report", "directions", "sanity", "ratios", "contract", "shuffle"])
    p.add_argument("root")
    p.add_argument("--config")
    p.add_argument("--master")
    p.add_argument("--patients", help="comma-separated")
    p.add_argument("--cases", help="comma-separated; for sanity and ratios")
    p.add_argument("--strict", action="store_true", help="index: fail where declared and parsed seizures differ")
    p.add_argument("--method", choices=sorted(config.METHODS))
    p.add_argument("--param", action="append", default=[], metavar="K=V")
    p.add_argument("--warm-start-s", type=float)
    p.add_argument("--source", default="signals", help="features: the signals, or adaptive/SETTING")
    p.add_argument("--arms", help="comma-separated; else those of the settings")
    p.add_argument("--models", help="comma-separated; else those of the settings")
    p.add_argument("--overwrite", action="store_true", help="do not skip what an earlier run has written")
    p.add_argument("--max-patients", type=int, help="baseline: only the first of the patients in order")
    p.add_argument("--tuning", choices=["nested", "fixed"], help="whether baseline and shuffle choose from the grids of the settings on inner folds of patients")
    p.add_argument("--min-consecutive", type=int, default=1)
    p.add_argument("--merge-gap-s", type=float)
    p.add_argument("--refractory-s", type=float, default=0.0)
    p.add_argument("--tag", default="", help="report: ends the name of the event report")
    p.add_argument("--reference", default="raw")
    p.add_argument("--dev", default="")
    p.add_argument("--focus", help="directions: the patient to look at")
    p.add_argument("--top", type=int, default=12)
    p.add_argument("--min-ictal", type=int, default=30)
    p.add_argument("--n-test", type=int, default=3, help="shuffle: patients held out")
    p.add_argument("--seeds", default="0", help="shuffle: comma-separated")
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> list[DataFrame]:
    """The tables that an entry shows."""
    cfg = config.load(a.config)
    if a.tuning:
        cfg["evaluation"]["tuning"]["mode"] = a.tuning
    listed = lambda v: v.split(",") if v else None
    patients, cases = listed(a.patients), listed(a.cases)
    if a.entry == "index":
        return [cohort.summary(entries.index(spark, a.root, cfg, patients, strict=a.strict), float(cfg["dataset"]["fs"]))]
    if a.entry == "preprocess":
        return [entries.preprocess(spark, a.root, cfg, patients, a.overwrite).groupBy("status").count()]
    if a.entry == "adapt":
        params = {k: ast.literal_eval(v) for k, v in (x.split("=", 1) for x in a.param)}
        return [entries.adapt(spark, a.root, cfg, a.method, params, a.warm_start_s, patients, a.overwrite).groupBy("status").count()]
    if a.entry == "windows":
        return [entries.make_windows(spark, a.root, cfg, patients)]
    if a.entry == "features":
        return [entries.extract_features(spark, a.root, cfg, patients, a.source)]
    if a.entry == "baseline":
        return [entries.baseline(spark, a.root, cfg, listed(a.arms), listed(a.models), patients, a.max_patients)]
    if a.entry == "report":
        return list(entries.report(spark, a.root, cfg, a.reference, a.dev.split(","), a.tag, min_consecutive=a.min_consecutive, merge_gap_s=a.merge_gap_s, refractory_s=a.refractory_s).values())
    if a.entry == "directions":
        return list(entries.feature_directions(spark, a.root, a.min_ictal, a.top, a.focus))
    if a.entry == "sanity":
        return [entries.feature_sanity(spark, a.root, cfg, cases)]
    if a.entry == "ratios":
        return [entries.adaptive_ratios(spark, a.root, cases)]
    if a.entry == "contract":
        return [entries.check_contract(spark, a.root)]
    return [entries.shuffle_checks(spark, a.root, cfg, listed(a.models) or cfg["evaluation"]["models"], a.n_test, [int(s) for s in a.seeds.split(",")])]


def main() -> None:
    a = parser().parse_args()
    spark = session.build(a.master)
    for df in run(spark, a):
        df.show(1000, truncate=False)
    clear(spark)


if __name__ == "__main__":
    main()
