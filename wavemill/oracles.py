"""DuckDB twins of the queries in ``wavemill.queries``."""

from __future__ import annotations

PRED = """preds AS (
  SELECT user_id AS patient, CAST(user_id AS VARCHAR) AS "case",
    CAST(user_id AS VARCHAR) || '_' || CAST(CAST(floor((day(ts) - 1) / 10) AS INT) AS VARCHAR) AS file,
    CAST(512 * (row_number() OVER (PARTITION BY user_id, floor((day(ts) - 1) / 10) ORDER BY ts, event_id) - 1) AS BIGINT) AS start_sample,
    CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END AS y_true, value AS y_score,
    CASE WHEN value > 40 THEN 1 ELSE 0 END AS y_pred, event_type AS kind
  FROM events)"""


def runs(name: str, flag: str) -> str:
    return f"""{name} AS (
  SELECT patient, "case", file, min(start_sample) AS first, max(start_sample) AS last, count(*) AS n
  FROM (SELECT *, start_sample - 512 * row_number() OVER (PARTITION BY file ORDER BY start_sample) AS island FROM preds WHERE {flag} = 1)
  GROUP BY patient, "case", file, island)"""


def merged(k: int, gap: int) -> str:
    return f"""merged AS (
  SELECT patient, file, min(begins) + 1024 AS raise_sample, max(last) + 1024 AS end_sample
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY file ORDER BY begins) AS alarm
        FROM (SELECT *, CASE WHEN begins - lag(last) OVER (PARTITION BY file ORDER BY begins) <= {gap} THEN 0 ELSE 1 END AS fresh
              FROM (SELECT *, first + {(k - 1) * 512} AS begins FROM alarm_runs WHERE n >= {k})))
  GROUP BY patient, file, alarm)"""


def accepted(refractory: int) -> str:
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY raise_sample) AS i FROM merged),
walk AS (
  SELECT patient, file, i, raise_sample, end_sample, raise_sample AS last_ok, true AS ok FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.patient, n.file, n.i, n.raise_sample, n.end_sample,
    CASE WHEN n.raise_sample - w.last_ok < {refractory} THEN w.last_ok ELSE n.raise_sample END, NOT n.raise_sample - w.last_ok < {refractory}
  FROM walk w JOIN numbered n ON n.file = w.file AND n.i = w.i + 1),
alarms AS (SELECT patient, file, raise_sample, end_sample FROM walk WHERE ok)"""


SEIZURES = """seizures AS (SELECT patient, file, first AS onset_sample, last + 1024 AS end_sample FROM seizure_runs),
seen AS (
  SELECT s.patient, s.file, s.onset_sample, s.end_sample, min(a.raise_sample) AS alarm_raise_sample
  FROM seizures s LEFT JOIN alarms a ON a.file = s.file AND a.raise_sample BETWEEN s.onset_sample AND s.end_sample GROUP BY ALL),
flagged AS (
  SELECT a.*, EXISTS (SELECT 1 FROM seizures s WHERE s.file = a.file AND a.raise_sample BETWEEN s.onset_sample AND s.end_sample) AS in_seizure FROM alarms a)"""


def event_tables(k: int = 1, gap: int = 512, refractory: int = 0) -> str:
    return f"WITH RECURSIVE {PRED}, {runs('seizure_runs', 'y_true')}, {runs('alarm_runs', 'y_pred')}, {merged(k, gap)}, {accepted(refractory)}, {SEIZURES}"


SUMMARY = """per AS (
  SELECT h.patient, coalesce(s.n_seizures, 0) AS n_seizures, coalesce(s.n_detected, 0) AS n_detected, s.n_detected / s.n_seizures AS event_sensitivity,
    coalesce(a.n_alarms, 0) AS n_alarms, coalesce(a.n_false_alarms, 0) AS n_false_alarms, h.hours_scored,
    coalesce(a.n_false_alarms, 0) / h.hours_scored AS fa_per_hour_event, s.median_latency_s, s.mean_latency_s
  FROM (SELECT patient, count(*) * 2.0 / 3600.0 AS hours_scored FROM preds GROUP BY patient) h
  LEFT JOIN (SELECT patient, count(*) AS n_seizures, count(alarm_raise_sample) AS n_detected, median((alarm_raise_sample - onset_sample) / 256.0) AS median_latency_s,
    avg((alarm_raise_sample - onset_sample) / 256.0) AS mean_latency_s FROM seen GROUP BY patient) s USING (patient)
  LEFT JOIN (SELECT patient, count(*) AS n_alarms, count(*) FILTER (NOT in_seizure) AS n_false_alarms FROM flagged GROUP BY patient) a USING (patient))"""


def auc(source: str, keys: str, label: str, score: str) -> str:
    """Rank sums with average ranks for ties."""
    return f"""SELECT {keys}, (sum(CASE WHEN l = 1 THEN r END) - sum(l) * (sum(l) + 1) / 2) / nullif(sum(l) * sum(1 - l), 0) AS auc
  FROM (SELECT {keys}, {label} AS l, rank() OVER (PARTITION BY {keys} ORDER BY {score}) + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2.0 AS r FROM {source}) GROUP BY {keys}"""


def window_metrics(source: str, keys: str) -> str:
    return f"""SELECT *, tp / nullif(n_ictal, 0) AS sensitivity, tn / nullif(n_windows - n_ictal, 0) AS specificity,
    CASE WHEN n_ictal > 0 THEN 2 * tp / nullif(2 * tp + fp + fn, 0) END AS f1, fp / (n_windows * 2.0 / 3600.0) AS fa_per_hour
  FROM (SELECT {keys}, count(*) AS n_windows, count(*) FILTER (y_true = 1) AS n_ictal, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp,
    count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn
    FROM {source} GROUP BY {keys}) JOIN ({auc(source, keys, "y_true", "y_score")}) USING ({keys})"""


RECORDINGS = f"""{PRED}, {runs('seizure_runs', 'y_true')},
files AS (SELECT patient, "case", file, count(*) * 512 + 512 AS n_samples FROM preds GROUP BY ALL),
bounds AS (SELECT file, first + 300 AS onset_sample, last + 1024 + 700 AS end_sample FROM seizure_runs),
cut AS (SELECT patient, file, unnest(range(0, n_samples - 1024 + 1, 512)) AS start_sample FROM files WHERE n_samples >= 1024),
touched AS (
  SELECT c.patient, c.file, c.start_sample, coalesce(bool_or(c.start_sample >= b.onset_sample AND c.start_sample + 1024 <= b.end_sample), false) AS inside, count(b.file) > 0 AS touches
  FROM cut c LEFT JOIN bounds b ON b.file = c.file AND c.start_sample + 1024 > b.onset_sample AND c.start_sample < b.end_sample GROUP BY ALL)"""

CALIBRATION = f"""{PRED},
placed AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY "case", file, start_sample) AS rn FROM preds),
firsts AS (SELECT *, min(CASE WHEN y_true = 1 THEN rn END) OVER (PARTITION BY patient) AS first FROM placed),
early AS (SELECT *, y_true = 0 AND (first IS NULL OR rn < first) AS early FROM firsts),
counted AS (SELECT *, count(*) FILTER (early) OVER (PARTITION BY patient) AS n FROM early),
chosen AS (SELECT *, CASE WHEN n < 5 THEN y_true = 0 ELSE early END AS cand FROM counted),
marked AS (SELECT *, cand AND sum(CAST(cand AS INT)) OVER (PARTITION BY patient ORDER BY rn) <= 10 AS is_calibration FROM chosen),
stats AS (SELECT patient, avg(y_score) AS m, stddev_pop(y_score) AS s FROM marked WHERE is_calibration GROUP BY patient),
scaled AS (SELECT k.* EXCLUDE (y_score), CASE WHEN m IS NULL THEN y_score ELSE (y_score - m) / greatest(s, 1e-8) END AS y_score FROM marked k LEFT JOIN stats USING (patient))"""

INDEX = """idx AS (
  SELECT *, row_number() OVER (PARTITION BY patient ORDER BY "case", k, file) AS file_order FROM (
    SELECT o_custkey AS patient, CAST(o_custkey AS VARCHAR) || 'c' || CAST(o_orderkey % 2 AS VARCHAR) AS "case", o_orderkey AS k,
      CAST(o_custkey AS VARCHAR) || 'c' || CAST(o_orderkey % 2 AS VARCHAR) || '_' || CAST(o_orderkey AS VARCHAR) AS file,
      CAST(floor(o_totalprice / 100) AS DOUBLE) AS duration_s, CASE WHEN o_orderstatus = 'F' THEN 'seizure' ELSE 'seizure_free' END AS role,
      CASE WHEN o_orderpriority LIKE '5%' THEN 'missing_channel:P7-O1' END AS bad
    FROM orders))"""

COHORT = f"""{INDEX},
ok AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY file_order) = 1 AS is_first FROM idx WHERE bad IS NULL),
has AS (SELECT patient, bool_or(role = 'seizure') AS any_seizure, sum(CASE WHEN role <> 'seizure' AND is_first THEN duration_s / 3600.0 ELSE 0 END) AS spent FROM ok GROUP BY patient),
cand AS (
  SELECT *, row_number() OVER (PARTITION BY patient ORDER BY file_order) - 1 AS pos, count(*) OVER (PARTITION BY patient) AS n
  FROM ok WHERE role <> 'seizure' AND NOT is_first),
halves AS (
  SELECT DISTINCT n, CAST(0 AS BIGINT) AS lo, n AS hi, 0 AS depth FROM cand
  UNION ALL
  SELECT n, CASE WHEN side = 0 THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN side = 0 THEN (lo + hi) // 2 ELSE hi END, depth + 1
  FROM halves, (SELECT unnest([0, 1]) AS side) WHERE lo < hi),
bis AS (SELECT n, (lo + hi) // 2 AS pos, row_number() OVER (PARTITION BY n ORDER BY depth, lo) AS r FROM halves WHERE lo < hi),
filled AS (
  SELECT c.file, spent + coalesce(sum(duration_s / 3600.0) OVER (PARTITION BY c.patient ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM cand c JOIN bis USING (n, pos) JOIN has h ON h.patient = c.patient),
cohort AS (
  SELECT i.*, coalesce(h.any_seizure, false) AND i.bad IS NULL AND (i.role = 'seizure' OR coalesce(o.is_first, false) OR coalesce(f.used < 1.0, false)) AS include, coalesce(h.any_seizure, false) AS any_seizure
  FROM idx i LEFT JOIN has h USING (patient) LEFT JOIN ok o USING (file) LEFT JOIN filled f USING (file)),
reasoned AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN NOT any_seizure THEN 'no_seizure_patient' WHEN include THEN '' ELSE 'over_cap' END AS exclude_reason FROM cohort)"""

VECTORS = """vec AS (SELECT vec_id, vec_id % 10 AS patient, CASE WHEN label < 3 THEN 1 ELSE 0 END AS label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)"""
LONG = f"""{VECTORS}, long AS (SELECT vec_id, patient, label, generate_subscripts(x, 1) - 1 AS feature, unnest(x) AS value FROM vec)"""
AUCS = f"""{LONG}, enough AS (SELECT patient FROM vec GROUP BY patient HAVING sum(label) >= 3 AND sum(label) < count(*)),
eligible AS (SELECT long.* FROM long JOIN enough USING (patient)), aucs AS ({auc('eligible', 'patient, feature', 'label', 'value')})"""

TD = f"""{VECTORS},
d AS (SELECT vec_id, x, list_avg(x) AS m, list_transform(range(2, len(x) + 1), lambda i: x[i] - x[i - 1]) AS dx FROM vec),
e AS (SELECT *, list_transform(range(2, len(dx) + 1), lambda i: dx[i] - dx[i - 1]) AS ddx FROM d),
s AS (SELECT vec_id, m, list_avg(list_transform(x, lambda v: (v - m) * (v - m))) AS m2, list_avg(list_transform(x, lambda v: (v - m) * (v - m) * (v - m))) AS m3,
  list_avg(list_transform(x, lambda v: (v - m) * (v - m) * (v - m) * (v - m))) AS m4, list_sum(list_transform(dx, lambda v: abs(v))) AS ll,
  list_var_pop(dx) AS d1, list_var_pop(ddx) AS d2 FROM e)"""

KALMAN = """b AS (
  SELECT user_id, place // 4 AS block, greatest(least(0.5 * ln(sum(value * value) / 4 + 1e-6), 9.210340371976184), -2.302585092994046) AS z
  FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM events) GROUP BY ALL HAVING count(*) = 4),
k AS (
  SELECT user_id, block, z AS s, CAST(1.0 AS DOUBLE) AS p FROM b WHERE block = 0
  UNION ALL
  SELECT b.user_id, b.block, k.s + (k.p + 0.1) / (k.p + 0.1 + 1.0) * (b.z - k.s), (1 - (k.p + 0.1) / (k.p + 0.1 + 1.0)) * (k.p + 0.1)
  FROM k JOIN b ON b.user_id = k.user_id AND b.block = k.block + 1)"""

ARMS = f"""{CALIBRATION},
both_arms AS (
  SELECT 'raw' AS arm, patient, y_true, y_pred, y_score FROM preds
  UNION ALL SELECT 'standardised', patient, y_true, CASE WHEN y_score > 0.5 THEN 1 ELSE 0 END, y_score FROM scaled),
measured AS ({window_metrics('both_arms', 'arm, patient')}),
tall AS (UNPIVOT (SELECT arm, patient, sensitivity, specificity, auc FROM measured) ON sensitivity, specificity, auc INTO NAME metric VALUE value),
paired AS (SELECT a.arm, a.patient, a.metric, a.value, r.value AS reference_value FROM tall a JOIN tall r ON r.arm = 'raw' AND a.arm <> 'raw' AND r.patient = a.patient AND r.metric = a.metric),
tagged AS (SELECT *, 'all' AS subset FROM paired UNION ALL SELECT *, CASE WHEN patient < 50 THEN 'dev' ELSE 'eval' END FROM paired)"""

SUMMARIES = """o AS (SELECT CAST(o_custkey AS VARCHAR) AS "case", o_orderkey AS k, 'f' || CAST(o_orderkey AS VARCHAR) || '.edf' AS file, o_orderkey % 1000 AS s, o_orderkey % 3 AS n FROM orders),
z AS (
  SELECT "case", file, CAST(s AS DOUBLE) AS seizure_start_s, CAST(s + 40 AS DOUBLE) AS seizure_end_s FROM o WHERE n >= 1
  UNION ALL SELECT "case", file, CAST(s + 100 AS DOUBLE), CAST(s + 100 + k % 7 - 2 AS DOUBLE) FROM o WHERE n >= 2 AND k % 7 > 2)"""

HASH = "md5('{seed}|' || file || '|' || CAST(start_sample AS VARCHAR))"
ALLOCATION = """total AS (SELECT sum(n) AS t FROM counts), target AS (SELECT least(greatest({target}, 0), t) AS g, t FROM total),
shares AS (SELECT patient, n, g, t, n / t * g AS raw, {base} AS base FROM counts, target),
short AS (SELECT *, g - sum(base) OVER () AS missing, n > base AS room FROM shares),
given AS (SELECT *, CASE WHEN room AND row_number() OVER (PARTITION BY room ORDER BY raw - base DESC, patient) <= missing THEN 1 ELSE 0 END AS extra FROM short),
alloc AS (SELECT patient, n, CAST(CASE WHEN g >= t THEN n ELSE least(base + extra, n) END AS BIGINT) AS alloc FROM given)"""

ORACLES: dict[str, str] = {
    "event_summary": event_tables(2, 1024, 4096) + f""", {SUMMARY} SELECT patient, n_seizures, n_detected, round(event_sensitivity, 6) AS event_sensitivity, n_alarms, n_false_alarms,
  round(hours_scored, 6) AS hours_scored, round(fa_per_hour_event, 6) AS fa_per_hour_event, round(median_latency_s, 6) AS median_latency_s, round(mean_latency_s, 6) AS mean_latency_s FROM per""",
    "event_seizures": event_tables() + " SELECT file, onset_sample, end_sample, alarm_raise_sample IS NOT NULL AS detected, alarm_raise_sample, round((alarm_raise_sample - onset_sample) / 256.0, 6) AS latency_s FROM seen",
    "event_alarms": event_tables() + " SELECT file, raise_sample, end_sample, in_seizure FROM flagged",
    "event_report": event_tables() + f""", {SUMMARY} SELECT 'raw' AS arm, CASE WHEN patient % 2 = 0 THEN 'even' ELSE 'odd' END AS model, CAST(sum(n_seizures) AS BIGINT) AS n_seizures, CAST(sum(n_detected) AS BIGINT) AS n_detected,
  round(avg(event_sensitivity), 3) AS mean_sensitivity, round(avg(fa_per_hour_event), 3) AS mean_fa_per_hour, round(median(median_latency_s), 3) AS median_latency_s FROM per GROUP BY ALL""",
    "seizure_runs": f"WITH {PRED}, {runs('seizure_runs', 'y_true')} SELECT file, first, last, n FROM seizure_runs",
    "alarm_runs_merged": f"WITH {PRED}, {runs('alarm_runs', 'y_pred')}, {merged(2, 1024)} SELECT file, raise_sample, end_sample FROM merged",
    "roc_auc_by_patient": f"WITH {PRED} SELECT patient, round(auc, 6) AS auc FROM ({auc('preds', 'patient', 'y_true', 'y_score')})",
    "roc_auc_tied": f"WITH {PRED}, tied AS (SELECT kind, CASE WHEN patient % 3 = 0 THEN 1 ELSE 0 END AS y, floor(y_score / 25) AS v FROM preds) SELECT kind, round(auc, 6) AS auc FROM ({auc('tied', 'kind', 'y', 'v')})",
    "window_metrics": f"""WITH {PRED} SELECT patient, n_windows, n_ictal, tp, fp, tn, fn, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(f1, 6) AS f1,
  round(fa_per_hour, 6) AS fa_per_hour, round(auc, 6) AS auc FROM ({window_metrics('preds', 'patient')})""",
    "metrics_summary": f"""WITH {PRED}, parts AS (SELECT *, CASE WHEN patient % 2 = 0 THEN 'even' ELSE 'odd' END AS arm FROM preds), measured AS ({window_metrics('parts', 'arm, patient')}),
  tall AS (UNPIVOT (SELECT arm, sensitivity, specificity, f1, auc, fa_per_hour FROM measured) ON sensitivity, specificity, f1, auc, fa_per_hour INTO NAME metric VALUE value)
  SELECT arm, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS median, count(value) AS n_patients FROM tall GROUP BY arm, metric""",
    "sliding_windows_labelled": f"WITH {RECORDINGS} SELECT file, start_sample, start_sample / 256.0 AS t_start_s, CASE WHEN inside THEN 1 ELSE 0 END AS label FROM touched WHERE inside OR NOT touches",
    "sliding_windows_keep_boundary": f"WITH {RECORDINGS} SELECT file, start_sample, start_sample / 256.0 AS t_start_s, CASE WHEN inside OR touches THEN 1 ELSE 0 END AS label FROM touched",
    "window_counts": f"WITH {RECORDINGS} SELECT patient, count(*) AS n_windows, count(*) FILTER (inside) AS n_ictal, round(avg(CAST(inside AS INT)), 6) AS ictal_fraction FROM touched WHERE inside OR NOT touches GROUP BY patient",
    "calibration_mask": f"WITH {CALIBRATION} SELECT patient, file, start_sample, is_calibration FROM marked",
    "standardised_features": f"WITH {CALIBRATION} SELECT patient, file, start_sample, round(y_score, 6) AS y_score FROM scaled",
    "train_allocation": f"WITH {PRED}, counts AS (SELECT patient, count(*) AS n FROM preds WHERE y_true = 0 GROUP BY patient), " + ALLOCATION.format(target="floor(t / 3)", base="greatest(floor(n / t * g), least(1, n))") + " SELECT patient, n, alloc FROM alloc",
    "train_sample": f"""WITH {PRED}, counts AS (SELECT patient, count(*) AS n FROM preds WHERE y_true = 0 GROUP BY patient), """ + ALLOCATION.format(target="(SELECT count(*) FROM preds WHERE y_true = 1)", base="floor(n / t * g)") + f""",
  ranked AS (SELECT p.*, row_number() OVER (PARTITION BY p.patient ORDER BY {HASH.format(seed=42)}, file, start_sample) AS rn FROM preds p WHERE y_true = 0)
  SELECT patient, file, start_sample, y_true AS label FROM preds WHERE y_true = 1
  UNION ALL SELECT r.patient, r.file, r.start_sample, 0 FROM ranked r JOIN alloc a ON a.patient = r.patient AND r.rn <= a.alloc""",
    "shuffled_label_counts": f"WITH {PRED} SELECT y_true AS label, count(*) AS n FROM preds GROUP BY y_true",
    "file_index": f"WITH {INDEX} SELECT patient, \"case\", file, CAST(file_order AS INT) AS file_order, duration_s, CAST(round_even(duration_s * 256, 0) AS BIGINT) AS n_samples, role FROM idx",
    "cohort_selected": f"WITH RECURSIVE {COHORT} SELECT patient, file, CAST(file_order AS INT) AS file_order, include, exclude_reason FROM reasoned",
    "cohort_summary": f"""WITH RECURSIVE {COHORT} SELECT patient, count(*) AS files, count(*) FILTER (role = 'seizure') AS seizure_files, round(sum(CASE WHEN role = 'seizure_free' THEN duration_s / 3600.0 ELSE 0 END), 6) AS seizure_free_hours,
  round(sum(duration_s / 3600.0), 6) AS total_hours, round(sum(duration_s) * 256 * 18 * 4 / 1e9, 6) AS cache_gb FROM reasoned WHERE include GROUP BY patient""",
    "cohort_validation": f"WITH RECURSIVE {COHORT} SELECT patient, count(*) FILTER (include) = 0 AS lost, count(*) FILTER (include AND role = 'seizure_free') = 0 AS no_seizure_free, count(*) FILTER (NOT include) AS n_excluded FROM reasoned GROUP BY patient",
    "exclude_reasons": f"WITH RECURSIVE {COHORT} SELECT exclude_reason, count(*) AS n FROM reasoned GROUP BY exclude_reason",
    "patient_map_join": "SELECT n_name, CASE n_name WHEN 'NATION_1' THEN 'p01' WHEN 'NATION_2' THEN 'p01' WHEN 'NATION_3' THEN 'p02' ELSE n_name END AS patient FROM nation",
    "patients_replaced": "WITH o AS (SELECT o_custkey AS patient, o_orderkey, o_orderstatus FROM orders) SELECT * FROM o WHERE o_orderstatus = 'F' OR (o_orderstatus <> 'F' AND patient NOT IN (SELECT patient FROM o WHERE o_orderstatus = 'F'))",
    "latest_per_key": "SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) = 1",
    "ratio_pivot": "SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS F, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS O, round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS P FROM orders GROUP BY o_orderpriority",
    "annotation_parse": f"WITH {SUMMARIES} SELECT \"case\", file, row_number() OVER (PARTITION BY \"case\", file ORDER BY seizure_start_s, seizure_end_s) - 1 AS seizure_idx, seizure_start_s, seizure_end_s FROM z",
    "annotation_durations": "SELECT 'f' || CAST(o_orderkey AS VARCHAR) || '.edf' AS file, CAST(d + CASE WHEN d < 0 THEN 86400 ELSE 0 END AS DOUBLE) AS duration_s FROM (SELECT o_orderkey, ((o_orderkey + 1) % 26 - o_orderkey % 26) * 3600 + 1 AS d FROM orders)",
    "annotation_problems": "SELECT CAST(o_orderkey % 3 AS INT) AS declared, count(*) AS files, count(*) AS agree FROM orders GROUP BY declared",
    "td_features": f"""WITH {TD} SELECT vec_id, round(m, 6) AS mean, round(sqrt(m2), 6) AS std, round(CASE WHEN m2 > 0 THEN m3 / (sqrt(m2) * m2) ELSE 0 END, 6) AS skew, round(CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 ELSE 0 END, 6) AS kurt,
  round(ll, 6) AS line_length, round(m2, 6) AS hjorth_activity, round(sqrt(d1 / m2), 6) AS hjorth_mobility, round(sqrt(d2 / d1) / sqrt(d1 / m2), 6) AS hjorth_complexity FROM s""",
    "line_length": f"WITH {TD} SELECT vec_id, round(ll, 6) AS line_length FROM s",
    "window_slices": f"WITH {VECTORS}, w AS (SELECT vec_id, x, unnest(range(0, len(x) - 16 + 1, 8)) AS start_sample FROM vec) SELECT vec_id, start_sample, start_sample / 64.0 AS t_start_s, round(list_sum(x[start_sample + 1:start_sample + 16]), 6) AS total FROM w",
    "feature_direction": f"WITH {AUCS} SELECT patient, CAST(feature AS INT) AS feature, round(auc, 6) AS auc FROM aucs",
    "direction_summary": f"""WITH {AUCS}, rest AS (SELECT p.patient, p.feature, p.auc, median(o.auc) AS consensus, count(o.auc) AS others FROM aucs p LEFT JOIN aucs o ON o.feature = p.feature AND o.patient <> p.patient GROUP BY ALL),
  strong AS (SELECT *, others >= 2 AND abs(consensus - 0.5) >= 0.05 AS is_strong FROM rest)
  SELECT patient, round(avg(abs(auc - 0.5)), 6) AS separability, count(*) FILTER (is_strong) AS n_strong_features, round(avg(CASE WHEN is_strong THEN CAST(sign(auc - 0.5) = sign(consensus - 0.5) AS INT) END), 6) AS agreement FROM strong GROUP BY patient""",
    "feature_auc_pivot": f"WITH {AUCS} SELECT CAST(feature AS INT) AS feature, " + ", ".join(f"max(round(auc, 6)) FILTER (patient = {i}) AS p{i}" for i in range(10)) + " FROM aucs GROUP BY feature",
    "feature_sanity": f"""WITH {LONG}, w AS (SELECT vec_id, label, feature // 4 AS feature, avg(value) AS v FROM long GROUP BY ALL),
  m AS (SELECT feature, avg(v) FILTER (label = 0) AS interictal, avg(v) FILTER (label = 1) AS ictal FROM w GROUP BY feature)
  SELECT feature, round(interictal, 5) AS interictal, round(ictal, 5) AS ictal, round(100 * (ictal - interictal) / abs(interictal), 5) AS pct_change, CASE WHEN ictal > interictal THEN 'up' WHEN ictal < interictal THEN 'down' ELSE 'same' END AS direction FROM m""",
    "leakage_checks": f"""WITH {CALIBRATION}
  SELECT 'shared_patients' AS rule, count(*) AS n FROM (SELECT patient FROM preds WHERE patient % 3 <> 0 INTERSECT SELECT patient FROM preds WHERE patient % 2 = 0)
  UNION ALL SELECT 'split_cases', count(*) FROM (SELECT "case" FROM preds GROUP BY "case" HAVING count(DISTINCT patient + y_pred * CAST(patient % 5 = 0 AS INT)) > 1)
  UNION ALL SELECT 'scored_calibration', count(*) FROM marked WHERE is_calibration AND start_sample >= 2048
  UNION ALL SELECT 'duplicates', count(*) FROM (SELECT 1 FROM preds GROUP BY "case", file, start_sample HAVING count(*) > 1)
  UNION ALL SELECT 'unknown_patients', count(*) FROM customer WHERE c_custkey NOT IN (SELECT patient FROM preds)""",
    "finite_features": f"WITH {PRED} SELECT kind, count(*) FILTER (y_true = 0 OR y_score = 0) AS n_zero, round(sum(CASE WHEN y_true = 1 THEN y_score ELSE 0 END), 4) AS total FROM preds GROUP BY kind",
    "arm_compare_means": f"WITH {ARMS} SELECT arm, subset, metric, count(*) AS n_patients, round(avg(reference_value), 6) AS mean_reference, round(avg(value), 6) AS mean_arm, round(avg(value - reference_value), 6) AS mean_diff FROM tagged GROUP BY ALL",
    "kalman_gain": f"WITH RECURSIVE {KALMAN} SELECT user_id, count(*) AS n_blocks, round(max_by(s, block), 6) AS log_amplitude FROM k GROUP BY user_id",
    "power_contrast": f"""WITH {PRED}, c AS (SELECT *, CAST(round(y_score * 100) AS BIGINT) * CAST(round(y_score * 100) AS BIGINT) AS power FROM preds),
  b AS (SELECT *, CAST(sum(power) OVER ahead AS BIGINT) AS b_sum, count(power) OVER ahead AS b_n FROM c WINDOW ahead AS (PARTITION BY file ORDER BY start_sample ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
  g AS (SELECT *, start_sample - 512 * row_number() OVER (PARTITION BY file ORDER BY start_sample) AS island FROM b WHERE y_true = 1),
  r AS (SELECT file, min(start_sample) AS onset_sample, CAST(sum(power) AS BIGINT) AS power_inside, count(*) AS n_inside, first(b_sum ORDER BY start_sample) AS power_before, first(b_n ORDER BY start_sample) AS n_before FROM g GROUP BY file, island)
  SELECT *, round(CASE WHEN n_before > 0 AND power_before > 0 THEN (power_inside / n_inside) / (power_before / n_before) END, 4) AS contrast FROM r""",
}

ORACLES["strongest_features"] = f"""WITH {AUCS}, m AS (SELECT feature, median(auc) AS consensus, max(auc) FILTER (patient = 3) AS focus FROM aucs GROUP BY feature)
  SELECT CAST(feature AS INT) AS feature, round(consensus, 6) AS consensus, round(focus, 6) AS focus, sign(focus - 0.5) = -sign(consensus - 0.5) AS flipped FROM m ORDER BY round(abs(consensus - 0.5), 9) DESC, m.feature LIMIT 12"""


def allocated(counts: str, target: str, base: str) -> str:
    return f"(WITH counts AS ({counts}), {ALLOCATION.format(target=target, base=base)} SELECT patient, alloc AS n FROM alloc)"


_SHARE = "floor(n / t * g)"
_WANTED = "(SELECT least(n_ictal, n_other) FROM sizes)"
ORACLES["train_sample_capped"] = f"""WITH {PRED}, sizes AS (SELECT count(*) FILTER (y_true = 1) AS n_ictal, count(*) FILTER (y_true = 0) AS n_other FROM preds),
scale AS (SELECT CASE WHEN n_ictal + least(n_ictal, n_other) > 1000 THEN 1000 / (n_ictal + least(n_ictal, n_other)) ELSE 1 END AS k FROM sizes),
other AS (SELECT * FROM {allocated('SELECT patient, count(*) AS n FROM preds WHERE y_true = 0 GROUP BY patient', _WANTED, _SHARE)} WHERE n > 0)
SELECT patient, 1 AS label, n FROM {allocated('SELECT patient, count(*) AS n FROM preds WHERE y_true = 1 GROUP BY patient', '(SELECT greatest(1, round_even(n_ictal * k, 0)) FROM sizes, scale)', f'greatest({_SHARE}, least(1, n))')} WHERE n > 0
UNION ALL SELECT patient, 0, n FROM {allocated('SELECT patient, n FROM other', f'(SELECT round_even({_WANTED} * k, 0) FROM scale)', _SHARE)} WHERE n > 0"""


def _by_fold(name: str, source: str, n: str, goal: str, base: str = "floor(raw_)") -> str:
    """CTEs that share ``goal`` out in each fold; ``name`` has fold, patient and alloc beside the columns of ``source``."""
    return f"""{name}_r AS (SELECT *, {n} AS n_, sum({n}) OVER (PARTITION BY fold) AS t_ FROM {source}),
{name}_g AS (SELECT *, least(greatest({goal}, 0), t_) AS g_ FROM {name}_r), {name}_w AS (SELECT *, coalesce(n_ / t_, 0) * g_ AS raw_ FROM {name}_g),
{name}_b AS (SELECT *, {base} AS base_ FROM {name}_w), {name}_s AS (SELECT *, g_ - sum(base_) OVER (PARTITION BY fold) AS short_, n_ > base_ AS room_ FROM {name}_b),
{name} AS (SELECT fold, patient, n0, t1, asked, k, CAST(CASE WHEN g_ >= t_ THEN n_ ELSE least(base_ + CASE WHEN room_ AND row_number() OVER (PARTITION BY fold, room_ ORDER BY base_ - raw_, patient) <= short_ THEN 1 ELSE 0 END, n_) END AS BIGINT) AS alloc FROM {name}_s)"""


ORACLES["training_folds"] = f"""WITH {PRED}, c AS (SELECT patient, count(*) FILTER (y_true = 1) AS n1, count(*) FILTER (y_true = 0) AS n0 FROM preds GROUP BY patient),
per AS (SELECT fold, c.* FROM c, (SELECT unnest(range(10)) AS fold) WHERE patient <> fold),
sized AS (SELECT *, sum(n1) OVER (PARTITION BY fold) AS t1, sum(n0) OVER (PARTITION BY fold) AS t0 FROM per),
wanted AS (SELECT *, CASE WHEN t1 = 0 THEN t0 ELSE least(round_even(t1 * 2.0, 0), t0) END AS asked FROM sized),
scaled AS (SELECT *, CASE WHEN t1 = 0 THEN 1 ELSE least(1, 2000 / (t1 + asked)) END AS k FROM wanted),
{_by_fold("ictal", "scaled", "n1", "CASE WHEN k < 1 THEN greatest(1, round_even(t1 * k, 0)) ELSE t1 END", "greatest(floor(raw_), least(1, n_))")},
{_by_fold("first", "scaled", "n0", "asked")},
{_by_fold("rest", "(SELECT * RENAME (alloc AS n2) FROM first)", "n2", "CASE WHEN k < 1 THEN round_even(asked * k, 0) ELSE asked END")}
SELECT CAST(fold AS INT) AS fold, patient, 1 AS label, alloc AS n FROM ictal WHERE alloc > 0 UNION ALL SELECT CAST(fold AS INT), patient, 0, alloc FROM rest WHERE alloc > 0"""

ORACLES["group_folds"] = f"""WITH RECURSIVE {PRED}, line AS (SELECT patient, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, patient DESC) AS k FROM preds GROUP BY patient),
dealt AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS place, [CAST(0 AS BIGINT), 0, 0] AS load
  UNION ALL
  SELECT k, place, list_transform([1, 2, 3], lambda i: load[i] + CASE WHEN i = place THEN n ELSE 0 END) FROM (SELECT l.k, l.n, d.load, CAST(list_position(d.load, list_min(d.load)) AS BIGINT) AS place FROM dealt d JOIN line l ON l.k = d.k + 1)),
given AS (SELECT patient, n, CAST(place - 1 AS INT) AS split FROM dealt JOIN line USING (k))
SELECT patient, n, split, 3 AS n_splits, CAST(sum(n) OVER (PARTITION BY split) AS BIGINT) AS split_windows, count(*) OVER (PARTITION BY split) AS split_patients FROM given"""

ORACLES["stream_kalman"] = ORACLES["kalman_gain"]
ORACLES["stream_alarms"] = event_tables(2, 1024, 4096) + " SELECT file, raise_sample FROM alarms"

#: Values of each case in order of time; what a filter gives is compared by its mean square in each file.
_SAMPLES = f"""{PRED}, a AS (SELECT "case", file, CAST(y_score AS DOUBLE) AS x, row_number() OVER (PARTITION BY "case" ORDER BY CAST(split_part(file, '_', 2) AS INT), start_sample) AS i FROM preds)"""
_LEVELS = """SELECT "case", file, 'success' AS status, round(sqrt(avg(x * x)), 4) AS rms_in, round(sqrt(avg(CAST(CAST(e AS FLOAT) AS DOUBLE) * CAST(CAST(e AS FLOAT) AS DOUBLE))), 4) AS rms_out FROM"""
#: The first 20 values of a case run once before all of them; u holds the four values before each, zeros before the first of a run.
_PASTS = f"""{_SAMPLES},
q AS (SELECT "case", 0 AS run, file, i, x FROM a WHERE i <= 20 UNION ALL SELECT "case", 1, file, i, x FROM a),
u AS (SELECT "case", run, file, x, row_number() OVER (PARTITION BY "case" ORDER BY run, i) AS t, [lag(x, 1, 0) OVER own, lag(x, 2, 0) OVER own, lag(x, 3, 0) OVER own, lag(x, 4, 0) OVER own] AS u FROM q WINDOW own AS (PARTITION BY "case", run ORDER BY i))"""

ORACLES["nlms_filter"] = f"""WITH RECURSIVE {_PASTS},
k AS (
  SELECT "case", run, file, t, x, x AS e, [0.0::DOUBLE, 0.0, 0.0, 0.0] AS w FROM u WHERE t = 1
  UNION ALL
  SELECT "case", run, file, t, x, e, CASE WHEN power > 1e-6 THEN list_transform(range(1, 5), lambda j: w[j] + 0.005::DOUBLE * e / (1e-6 + power) * u[j]) ELSE w END
  FROM (SELECT u.*, k.w, u.x - list_dot_product(k.w, u.u) AS e, list_dot_product(u.u, u.u) AS power FROM k JOIN u ON u."case" = k."case" AND u.t = k.t + 1))
{_LEVELS} k WHERE run = 1 GROUP BY ALL"""

ORACLES["kalman_filter"] = f"""WITH RECURSIVE {_SAMPLES},
b AS (SELECT "case", (i - 1) // 8 AS block, greatest(least(0.5 * ln(sum(x * x) / 8 + 1e-6), ln(1e4)), ln(0.1)) AS z FROM a GROUP BY ALL HAVING count(*) = 8),
k AS (
  SELECT "case", block, z AS s, CAST(1.0 AS DOUBLE) AS p FROM b WHERE block = 0
  UNION ALL
  SELECT b."case", b.block, k.s + (k.p + 1e-4) / (k.p + 1e-4 + 1.0) * (b.z - k.s), (1 - (k.p + 1e-4) / (k.p + 1e-4 + 1.0)) * (k.p + 1e-4)
  FROM k JOIN b ON b."case" = k."case" AND b.block = k.block + 1)
{_LEVELS} (SELECT a.*, a.x * exp(-coalesce(k.s, 0)) AS e FROM a LEFT JOIN k ON k."case" = a."case" AND k.block = (a.i - 1) // 8 - 1) GROUP BY ALL"""

#: m is the inverse correlation matrix by rows; its trace stays below 400.
ORACLES["rls_filter"] = f"""WITH RECURSIVE {_PASTS},
k AS (
  SELECT "case", run, file, t, x, x AS e, [0.0::DOUBLE, 0.0, 0.0, 0.0] AS w, list_transform(range(0, 16), lambda j: CASE WHEN j % 5 = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS m FROM u WHERE t = 1
  UNION ALL
  SELECT "case", run, file, t, x, e, CASE WHEN learns THEN list_transform(range(1, 5), lambda j: w[j] + e * mu[j] / d) ELSE w END,
    CASE WHEN NOT learns THEN m WHEN trace > 400 THEN list_transform(new, lambda v: v * 400 / trace) ELSE new END
  FROM (SELECT *, new[1] + new[6] + new[11] + new[16] AS trace FROM (
    SELECT *, power > 1e-6 AND d > 1e-12 AS learns, list_transform(range(0, 16), lambda j: (m[j + 1] - mu[j // 4 + 1] / d * mu[j % 4 + 1]) / 0.9999::DOUBLE) AS new FROM (
      SELECT *, 0.9999::DOUBLE + list_dot_product(u, mu) AS d FROM (
        SELECT u.*, k.w, k.m, u.x - list_dot_product(k.w, u.u) AS e, list_dot_product(u.u, u.u) AS power, list_transform(range(0, 4), lambda r: list_dot_product(k.m[4 * r + 1 : 4 * r + 4], u.u)) AS mu
        FROM k JOIN u ON u."case" = k."case" AND u.t = k.t + 1)))))
{_LEVELS} k WHERE run = 1 GROUP BY ALL"""

#: Every second of the 64 components of a vector makes 32 values; pairs of values (i, i + 1) and (j, j + 1) match where both differ by at most r.
ORACLES["sample_entropy"] = f"""WITH {VECTORS},
d AS (SELECT vec_id, list_transform(range(0, 32), lambda i: x[2 * i + 1]) AS d FROM vec),
r AS (SELECT *, 0.2::DOUBLE * sqrt(list_var_pop(d)) AS r FROM d),
p AS (
  SELECT vec_id, r, i, j, abs(d[i + 1] - d[j + 1]) <= r AND abs(d[i + 2] - d[j + 2]) <= r AS pair, i < 30 AND j < 30 AS inner_part, coalesce(abs(d[i + 3] - d[j + 3]) <= r, false) AS third
  FROM r, range(0, 31) one(i), range(0, 31) other(j)),
t AS (SELECT vec_id, r, i, count(*) FILTER (pair) AS near2, count(*) FILTER (pair AND inner_part) AS near2_inner, count(*) FILTER (pair AND third) AS near3 FROM p GROUP BY ALL),
e AS (
  SELECT vec_id, r, sum(near2_inner) - 30 AS b, sum(near3) - 30 AS a, avg(ln(near2 / 31)) - avg(ln(CASE WHEN i < 30 THEN near3 / 30 END)) AS apen
  FROM t GROUP BY ALL)
SELECT vec_id, round(CAST(CAST(CASE WHEN r > 0 AND a > 0 AND b > 0 THEN -ln(a / b) ELSE 0 END AS FLOAT) AS DOUBLE), 4) AS sampen, round(CAST(CAST(CASE WHEN r > 0 THEN apen ELSE 0 END AS FLOAT) AS DOUBLE), 4) AS apen FROM e"""

ORACLES["chunk_slices"] = ORACLES["window_slices"]
ORACLES |= {"stream_nlms": ORACLES["nlms_filter"], "stream_rls": ORACLES["rls_filter"]}


# spectra, wavelets, screening features ---------------------------------------

BAND_EDGES = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 13), "beta": (13, 30), "gamma": (30, 32)}  # whole hertz of a band that starts at half a hertz, up to half the sampling rate
WINDOWS_256 = f"{VECTORS}, w AS (SELECT vec_id // 4 AS window_id, flatten(list(x ORDER BY vec_id)) AS x FROM vec GROUP BY ALL HAVING count(*) = 4)"
TRIG = "trig AS (SELECT i, k, cos(2 * pi() * i * k / 64) AS c, sin(2 * pi() * i * k / 64) AS s FROM range(64) a(i), range(33) b(k))"


def as_float(value: str) -> str:
    """A double that went through a column of single precision."""
    return f"round(CAST(CAST({value} AS FLOAT) AS DOUBLE), 4)"


def _trapezoid(low: int, high: int) -> str:
    return f"sum(d) FILTER (k BETWEEN {low} AND {high}) - sum(d) FILTER (k IN ({low}, {high})) / 2"


ORACLES["frequency_features"] = (
    f"""WITH {WINDOWS_256}, {TRIG},
g AS (SELECT window_id, pos, x[pos + 1:pos + 64] AS g FROM w, range(0, 193, 32) t(pos)),
v AS (SELECT window_id, pos, i, (g[i + 1] - list_avg(g)) * (0.5 - 0.5 * cos(2 * pi() * i / 64)) AS v FROM g, range(64) r(i)),
f AS (SELECT window_id, pos, k, power(sum(v * c), 2) + power(sum(v * s), 2) AS p FROM v JOIN trig USING (i) GROUP BY ALL),
d AS (SELECT window_id, k, avg(p) / (64 * 24) * CASE WHEN k BETWEEN 1 AND 31 THEN 2 ELSE 1 END AS d FROM f GROUP BY window_id, k),
b AS (SELECT window_id, {_trapezoid(1, 32)} AS whole, {', '.join(f'{_trapezoid(*e)} AS {n}' for n, e in BAND_EDGES.items())} FROM d GROUP BY window_id)
SELECT window_id, """
    + ", ".join([*[f"{as_float(f'log10({n} + 1e-12)')} AS logpow_{n}" for n in BAND_EDGES], *[f"{as_float(f'CASE WHEN whole > 0 THEN {n} / whole ELSE 0 END')} AS rel_{n}" for n in BAND_EDGES]])
    + " FROM b"
)

ORACLES["screening_features"] = (
    f"""WITH {VECTORS}, {TRIG},
v AS (SELECT vec_id, i, x[i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS v FROM vec, range(64) r(i)),
e AS (SELECT vec_id, k, power(sum(v * c), 2) + power(sum(v * s), 2) + 1e-20 AS e FROM v JOIN trig USING (i) WHERE k BETWEEN 1 AND 32 GROUP BY ALL),
q AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS q FROM e),
b AS (SELECT vec_id, -sum(q * ln(q)) AS spectral_entropy, {', '.join(f'sum(e) FILTER (k >= {low} AND k < {33 if n == "gamma" else high}) AS {n}' for n, (low, high) in BAND_EDGES.items())} FROM q GROUP BY vec_id),
d AS (SELECT vec_id, list_var_pop(x) + 1e-20 AS v0, list_transform(range(2, 65), lambda i: x[i] - x[i - 1]) AS dx FROM vec),
t AS (SELECT vec_id, v0, list_avg(list_transform(dx, lambda y: abs(y))) + 1e-20 AS ll, list_var_pop(dx) + 1e-20 AS v1, list_var_pop(list_transform(range(2, 64), lambda i: dx[i] - dx[i - 1])) + 1e-20 AS v2 FROM d)
SELECT vec_id, round(ln(v0), 6) AS log_variance, round(ln(ll), 6) AS log_line_length, round(spectral_entropy, 6) AS spectral_entropy, round(sqrt(v1 / v0), 6) AS mobility, round(sqrt(v2 * v0) / v1, 6) AS complexity, """
    + ", ".join(f"round(ln({n}), 6) AS log_{n}, round({n} / ({' + '.join(BAND_EDGES)}), 6) AS share_{n}" for n in BAND_EDGES)
    + " FROM b JOIN t USING (vec_id)"
)

SCALING = [0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278]  # fixed values: Daubechies, four vanishing moments


def _wavelet_levels(n: int = 256, levels: int = 5) -> str:
    """CTEs l1 to l5: the filtered half-rate lines (v low, d high), from l0, with edges mirrored at half points."""
    parts = ["taps(t, low, high) AS (VALUES " + ", ".join(f"({t}, {SCALING[t]!r}::DOUBLE, {(-1) ** t * SCALING[7 - t]!r}::DOUBLE)" for t in range(8)) + ")", f"l0 AS (SELECT window_id, i AS pos, x[i + 1] AS v FROM w, range({n}) r(i))"]
    for level in range(1, levels + 1):
        out = (n + 7) // 2
        pos = f"CASE WHEN 2 * j + t - 6 < 0 THEN 5 - 2 * j - t WHEN 2 * j + t - 6 >= {n} THEN {2 * n + 5} - 2 * j - t ELSE 2 * j + t - 6 END"
        parts.append(f"l{level} AS (SELECT window_id, j AS pos, sum(v * low) AS v, sum(v * high) AS d FROM (SELECT j, low, high, {pos} AS pos FROM range({out}) r(j), taps) JOIN l{level - 1} USING (pos) GROUP BY ALL)")
        n = out
    return ",\n".join(parts)


_LINES = " UNION ALL ".join([f"SELECT window_id, 'd{k}' AS part, d AS c FROM l{k}" for k in range(1, 6)] + ["SELECT window_id, 'a5', v FROM l5"])

def _energy(part: str) -> str:
    return as_float(f"log10(sum(c * c) FILTER (part = '{part}') + 1e-12)")


def _spread(part: str) -> str:
    return as_float(f"stddev_pop(c) FILTER (part = '{part}')")


_PARTS = ["d1", "d2", "d3", "d4", "d5", "a5"]
ORACLES["wavelet_features"] = (
    f"WITH {WINDOWS_256}, {_wavelet_levels()}, lines AS ({_LINES}) SELECT window_id, "
    + ", ".join(f'{_energy(p)} AS "dwt_logE_{p}", {_spread(p)} AS dwt_std_{p}' for p in _PARTS)
    + " FROM lines GROUP BY window_id"
)

# exact tests of arms: how many of all choices of signs give each sum of doubled ranks, a pair a step
ORACLES["arm_tests"] = f"""WITH RECURSIVE {ARMS}, keyed AS (SELECT arm, subset, metric, value - reference_value AS d FROM tagged),
ranked AS (SELECT arm, subset, metric, d > 0 AS up, row_number() OVER one AS step, 2 * rank() OVER by_size + count(*) OVER same - 1 AS r FROM keyed WHERE d <> 0
  WINDOW one AS (PARTITION BY arm, subset, metric ORDER BY abs(d), d), by_size AS (PARTITION BY arm, subset, metric ORDER BY abs(d)), same AS (PARTITION BY arm, subset, metric, abs(d))),
sums(arm, subset, metric, step, total, chance) AS (
  SELECT DISTINCT arm, subset, metric, 0::BIGINT, 0::BIGINT, 1::DOUBLE FROM ranked
  UNION ALL
  SELECT s.arm, s.subset, s.metric, s.step + 1, s.total + CAST(chosen.k * r.r AS BIGINT), sum(s.chance / 2)
  FROM sums s JOIN ranked r ON r.arm = s.arm AND r.subset = s.subset AND r.metric = s.metric AND r.step = s.step + 1, (VALUES (0), (1)) chosen(k) GROUP BY 1, 2, 3, 4, 5),
ends AS (SELECT arm, subset, metric, count(*) AS n, sum(r) FILTER (up) AS up FROM ranked GROUP BY ALL),
tested AS (SELECT e.arm, e.subset, e.metric, e.n, least(1, 2 * least(sum(chance) FILTER (total >= coalesce(up, 0)), sum(chance) FILTER (total <= coalesce(up, 0)))) AS p FROM ends e JOIN sums s ON s.arm = e.arm AND s.subset = e.subset AND s.metric = e.metric AND s.step = e.n GROUP BY e.arm, e.subset, e.metric, e.n, e.up),
counts AS (SELECT arm, subset, metric, CAST(count(*) AS INT) AS n_patients, CAST(count(*) FILTER (d > 0) AS INT) AS n_arm_greater, CAST(count(*) FILTER (d < 0) AS INT) AS n_reference_greater FROM keyed GROUP BY ALL)
SELECT arm, subset, metric, n_patients, n_arm_greater, n_reference_greater, round(coalesce(p, 1), 9) AS p_value, round(coalesce(least(1, 2 / power(2, n)), 1), 9) AS min_possible_p
FROM counts LEFT JOIN tested USING (arm, subset, metric)"""
