"""Tables of the pipeline as explicit types; readers never infer them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ANNOTATIONS = "patient string, case string, file string, seizure_idx int, seizure_start_s double, seizure_end_s double"
FILE_INDEX = "patient string, case string, file string, file_order int, duration_s double, n_samples long, n_seizures int, role string, include boolean, exclude_reason string"
SIGNALS = "case string, file string, channel string, chunk_idx int, start_sample long, n_samples int, samples array<float>"
WINDOWS = "patient string, case string, file string, start_sample long, t_start_s double, label tinyint"
PREDICTIONS = "patient string, case string, file string, start_sample long, y_true tinyint, y_score double, y_pred tinyint, arm string, model string"
PER_PATIENT = "patient string, n_windows long, n_ictal long, tp long, fp long, tn long, fn long, sensitivity double, specificity double, f1 double, auc double, fa_per_hour double"
PREPROCESS_LOG = "run_id string, file string, case string, status string, n_samples long, eeg_seconds double, elapsed_s double, flat_channels int, error string"
ADAPTIVE_LOG = "run_id string, setting string, patient string, case string, file string, status string, n_samples long, eeg_seconds double, rms_in double, rms_out double, elapsed_s double, error string"


def problems(df: DataFrame, expected: str) -> list[str]:
    """What keeps ``df`` from being a table of this type: missing columns, and columns of another type."""
    have = {f.name: f.dataType for f in df.schema}
    out = []
    for f in T.StructType.fromDDL(expected):
        if f.name not in have:
            out.append(f"missing:{f.name}")
        elif have[f.name] != f.dataType:
            out.append(f"type:{f.name}:{have[f.name].simpleString()}<>{f.dataType.simpleString()}")
    return out
