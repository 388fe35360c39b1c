"""Settings of a run: defaults, files with overrides, checks, and the names that follow from them."""

from __future__ import annotations

import copy
from itertools import product
from pathlib import Path

# The bipolar montage, the frequency bands, and the names of features.
CHANNELS = [
    "FP1-F7", "F7-T7", "T7-P7", "P7-O1", "FP1-F3", "F3-C3", "C3-P3", "P3-O1", "FP2-F4",
    "F4-C4", "C4-P4", "P4-O2", "FP2-F8", "F8-T8", "T8-P8", "P8-O2", "FZ-CZ", "CZ-PZ",
]
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}
TIME_DOMAIN = ["mean", "std", "skew", "kurt", "line_length", "hjorth_activity", "hjorth_mobility", "hjorth_complexity"]
NONLINEAR = ["sampen", "apen"]
DETAILS = ["d1", "d2", "d3", "d4", "d5", "a5"]

# The settings of a run, among them the case that is another case's patient and the second name of a channel.
DEFAULTS: dict = {
    "project": {"seed": 42},
    "dataset": {"fs": 256, "channels": CHANNELS, "max_seizure_free_hours_per_patient": 2.0, "patient_map": {"chb21": "chb01"}, "channel_aliases": {"T8-P8-0": "T8-P8"}},
    "segmentation": {"window_s": 4.0, "overlap": 0.5, "drop_boundary": True},
    "filter": {"low": 0.5, "high": 45.0, "transition": 1.0, "ripple_db": 60.0, "notch": 60.0, "q": 30.0},
    "features": {"nonlinear": True},
    "adaptive": {"method": "nlms", "warm_start_s": 60.0},
    "evaluation": {
        "arms": ["raw", "subject_standardised"],
        "models": ["svm", "rf"],
        "calibration": {"minutes": 10, "min_windows": 60},
        "train_sampling": {"interictal_to_ictal_ratio": 5, "max_train_windows": 30000},
        "feature_selection": {"method": "f_classif", "k": 100},
        "tuning": {"mode": "nested", "inner_splits": 3, "scoring": "roc_auc"},
        "grids": {
            "svm": {"C": [1, 10], "gamma": ["scale"]},
            "rf": {"n_estimators": [200], "max_depth": [None, 20], "min_samples_leaf": [1, 5]},
        },
        "fixed_params": {
            "svm": {"C": 1, "gamma": "scale"},
            "rf": {"n_estimators": 200, "max_depth": None, "min_samples_leaf": 1},
        },
    },
}
# The parameters of the adaptive methods, and the grid of the pilot screen.
METHODS = {
    "nlms": {"length": 16, "mu": 0.005, "eps": 1e-6},
    "rls": {"length": 8, "forgetting": 0.9999, "delta": 1.0, "eps": 1e-6, "cap_factor": 100.0},
    "kalman": {"block_s": 1.0, "q_over_r": 1e-4, "r": 1.0, "min_rms": 0.1, "max_rms": 1e4},
}
GRID = {
    "nlms": {"length": [8, 16, 32], "mu": [0.001, 0.005, 0.02]},
    "rls": {"length": [8, 16], "forgetting": [0.999, 0.9995, 0.9999]},
    "kalman": {"q_over_r": [1e-5, 3e-5, 1e-4, 1e-3, 1e-2]},
}
# How a setting's leading parameters are written in its name.
NAMED = {"nlms": {"length": "L", "mu": "mu"}, "rls": {"length": "L", "forgetting": "lam"}, "kalman": {"q_over_r": "qr", "block_s": "blk"}}
WARM_START_S = 60.0


def merged(base: dict, over: dict | None) -> dict:
    """``over`` laid on ``base``: tables merge, everything else (lists too) is replaced."""
    out = copy.deepcopy(base)
    for k, v in (over or {}).items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load(path: str | None = None, overrides: dict | None = None) -> dict:
    """Defaults, then a YAML file, then overrides; relative entries of ``paths`` start at the file's folder."""
    out = DEFAULTS
    if path:
        import yaml

        out = merged(out, yaml.safe_load(Path(path).read_text()) or {})
    out = merged(out, overrides)
    if path and "paths" in out:
        root = Path(path).resolve().parent
        out["paths"] = {k: str(p if (p := Path(v)).is_absolute() else root / p) for k, v in out["paths"].items()}
    return checked(out)


def checked(cfg: dict) -> dict:
    channels = cfg["dataset"]["channels"]
    if len(channels) != 18 or len(set(channels)) != 18:
        raise ValueError("exactly 18 distinct channels are needed")
    if not 0 <= float(cfg["segmentation"]["overlap"]) < 1:
        raise ValueError("overlap must be at least 0 and below 1")
    if float(cfg["segmentation"]["window_s"]) <= 0:
        raise ValueError("window_s must be positive")
    evaluation = cfg["evaluation"]
    for what, given, known in (("tuning.mode", evaluation["tuning"]["mode"], ("nested", "fixed")), ("tuning.scoring", evaluation["tuning"]["scoring"], ("roc_auc",)), ("feature_selection.method", evaluation["feature_selection"]["method"], ("f_classif",))):
        if given not in known:
            raise ValueError(f"evaluation.{what} is {given!r}; known: {', '.join(known)}")
    return cfg


def learning(cfg: dict, kind: str) -> dict:
    """What ``loso.predict`` is told about a model: grid (unless tuning is ``fixed``), fixed parameters, features, and training rows."""
    e = cfg["evaluation"]
    return {
        "grid": e["grids"].get(kind) if e["tuning"]["mode"] == "nested" else None,
        "fixed": e["fixed_params"].get(kind),
        "splits": int(e["tuning"]["inner_splits"]),
        "k": int(e["feature_selection"]["k"]),
        "ratio": float(e["train_sampling"]["interictal_to_ictal_ratio"]),
        "most": int(e["train_sampling"]["max_train_windows"]),
    }


def window_samples(cfg: dict) -> tuple[int, int]:
    """Length and step of a window in samples, rounded half to even."""
    length = round(float(cfg["segmentation"]["window_s"]) * float(cfg["dataset"]["fs"]))
    return length, round(length * (1 - float(cfg["segmentation"]["overlap"])))


def slug(channel: str) -> str:
    return channel.replace(" ", "_").replace("-", "_").upper()


def feature_names(nonlinear: bool = True) -> list[str]:
    """The 32 features of a channel in catalogue order (30 without the entropies)."""
    return [*TIME_DOMAIN, *[f"logpow_{b}" for b in BANDS], *[f"rel_{b}" for b in BANDS], *(NONLINEAR if nonlinear else []), *[f"dwt_logE_{d}" for d in DETAILS], *[f"dwt_std_{d}" for d in DETAILS]]


def feature_columns(channels: list[str], nonlinear: bool = True) -> list[str]:
    return [f"f_{f}_{slug(c)}" for f in feature_names(nonlinear) for c in channels]


def method_params(method: str, given: dict | None = None) -> dict:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if unknown := set(given or {}) - set(METHODS[method]):
        raise ValueError(f"unknown parameters of {method}: {sorted(unknown)}")
    return METHODS[method] | (given or {})


def tag(method: str, params: dict | None = None, warm_start_s: float = WARM_START_S) -> str:
    """Name of a setting: the method, its leading parameters, then by name whatever differs from the usual; a warm start that differs is ``ws``."""
    given, usual, short = method_params(method, params), METHODS[method], NAMED[method]
    changed = {k: k for k in sorted(given.keys() - short.keys()) if given[k] != usual[k]}
    name = method
    for key, written in (short | changed).items():
        name += f"_{written}{given[key]:g}"
    return name if warm_start_s == WARM_START_S else f"{name}_ws{warm_start_s:g}"


def grid(methods: list[str] | None = None) -> list[tuple[str, dict]]:
    """All settings of the screen, in order of the grid."""
    return [(m, dict(zip(GRID[m], v, strict=True))) for m in methods or GRID for v in product(*GRID[m].values())]


def aliases(cfg: dict) -> dict[str, list[str]]:
    """For each channel the other names it may have; the settings list them the other way round."""
    out: dict[str, list[str]] = {}
    for other, channel in (cfg["dataset"].get("channel_aliases") or {}).items():
        out.setdefault(channel, []).append(other)
    return out
