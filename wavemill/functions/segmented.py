"""NLMS and RLS of one channel in segments side by side, for many settings at once.

From given samples the weights of NLMS after a segment are an affine function of those
before it, and the inverse of the matrix of RLS is a sum that is forgotten at a
fixed rate. So each segment gives its function alone, a scan over these few numbers gives the state
that each segment begins with, and all segments are filtered at once from there.
The results are those of ``adaptive.run`` up to rounding. Where RLS scales its matrix down
(the cap on its trace) the sum does not hold; such a case and setting is told by ``capped``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import method_params
from ..shared import kept, partitions, running
from . import adaptive

#: Chunks in a segment, and segments that are filtered side by side.
CHUNKS, STACK = 32, 64


def _nlms_map(p: dict, s: dict, x: np.ndarray) -> np.ndarray:
    """Per segment the weights after it from weights of zero, then from each unit vector: (segments, 1 + length, length)."""
    n = p["length"]
    w = np.tile(np.vstack([np.zeros((1, n)), np.eye(n)]), (len(x), 1, 1))
    for i, u in adaptive._pasts(s, x):
        e = x[:, i, None] - np.einsum("krl,kl->kr", w, u)
        power = np.einsum("kl,kl->k", u, u)
        w += (np.where(power > p["eps"], p["mu"] / (p["eps"] + power), 0.0)[:, None] * e)[:, :, None] * u[:, None, :]
    return w


def _rls_map(p: dict, s: dict, x: np.ndarray) -> np.ndarray:
    """Per segment the share that stays of the inverse matrix, in the first column's first place, and what is added to it and to its product with the weights."""
    n = p["length"]
    line = np.concatenate([s["history"][:, ::-1], x], axis=1)
    u = np.lib.stride_tricks.sliding_window_view(line, n, axis=1)[:, : x.shape[1], ::-1]
    learns = np.einsum("kil,kil->ki", u, u) > p["eps"]
    later = learns[:, ::-1].cumsum(axis=1)[:, ::-1] - learns
    weighted = np.where(learns, p["forgetting"] ** later, 0.0)[:, :, None] * u
    out = np.zeros((len(x), n, n + 2))
    out[:, 0, 0] = p["forgetting"] ** learns.sum(axis=1)
    out[:, :, 1] = np.einsum("kil,ki->kl", weighted, x)
    out[:, :, 2:] = np.swapaxes(weighted, 1, 2) @ u
    return out


def _stacks(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of segments of one length, their samples, and the samples before them (as many for all, zeros before the first)."""
    x, lead = b.column("x"), b.column("lead")
    xs, at = x.flatten().to_numpy(), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())])
    ls, lat = lead.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lead.value_lengths().to_numpy())])
    sizes = np.diff(at)
    for n in np.unique(sizes):
        same = np.flatnonzero(sizes == n)
        for k in range(0, len(same), STACK):
            own = same[k : k + STACK]
            before = np.zeros((len(own), int(np.diff(lat).max(initial=0))))
            for row, i in zip(before, own, strict=True):
                got = ls[lat[i] : lat[i + 1]]
                row[len(row) - len(got) :] = got
            yield own, np.stack([xs[at[i] : at[i + 1]] for i in own]), before


def _state(method: str, p: dict, before: np.ndarray) -> dict[str, np.ndarray]:
    s = adaptive.start(method, p, len(before))
    line = np.hstack([np.zeros((len(before), p["length"])), before])
    s["history"][:] = line[:, line.shape[1] - p["length"] :][:, ::-1]
    return s


def run(signals: DataFrame, settings: list[tuple[str, dict]], fs: float, warm_start_s: float, order: tuple[str, ...] = ("file_order", "chunk_idx")) -> DataFrame:
    """(setting, case, *order, samples, capped): chunks (case, *order, samples of finite values, none empty) filtered by each of the settings, which go by their places in the list."""
    spark, warm = signals.sparkSession, round(warm_start_s * fs)
    methods = [(m, method_params(m, p)) for m, p in settings]
    rows = signals.select("case", *order, "samples", F.size("samples").alias("_n"))
    numbered = kept(running(rows, ["case"], list(order), {"_upto": "_n"}, "_rank"))
    longest, least = max(p["length"] for _, p in methods), numbered.agg(F.min("_n")).first()[0] or 1
    reach = -(-longest // least)  # chunks that may hold the samples before a segment
    chunks = max(CHUNKS, reach)
    own = F.struct(F.floor(F.col("_rank") / chunks).alias("seg"), F.lit(True).alias("own"))
    next_ = F.struct(F.floor(F.col("_rank") / chunks + 1).alias("seg"), F.lit(False).alias("own"))
    places = F.when(F.col("_rank") % chunks >= chunks - reach, F.array(own, next_)).otherwise(F.array(own))
    sent = numbered.select("case", F.explode(places).alias("p"), F.struct("_rank", *order, "samples").alias("c"))
    listed = lambda mine: F.array_sort(F.collect_list(F.when(F.col("p.own") == mine, F.col("c"))))
    met = sent.groupBy("case", F.col("p.seg").alias("seg")).agg(listed(True).alias("of"), listed(False).alias("before")).where("size(of) > 0")
    flat = lambda c: F.flatten(F.transform(c, lambda v: v["samples"]))
    segments = met.select("case", "seg", flat("of").alias("x"), flat("before").alias("lead"), F.transform("of", lambda v: F.size(v["samples"])).alias("sizes"), *[F.col("of")[o].alias(o) for o in order])
    segments = kept(segments.repartition(2 * max(partitions(spark), spark.sparkContext.defaultParallelism), "case", "seg"))

    def warmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for case, x in zip(b.column("case").to_pylist(), b.column("x").to_pylist(), strict=True):
                for k, (m, p) in enumerate(methods):
                    s = adaptive.start(m, p)
                    adaptive.process(m, p, s, np.array([x], float), fs)
                    out.append((case, -1, k, s["weights"].tobytes() + (s["p"].tobytes() if m == "rls" else b"")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            case, seg = b.column("case"), b.column("seg")
            for at, x, before in _stacks(b):
                for k, (m, p) in enumerate(methods):
                    got = (_nlms_map if m == "nlms" else _rls_map)(p, _state(m, p, before), x)
                    yield pa.RecordBatch.from_arrays([case.take(pa.array(at)), seg.take(pa.array(at)), pa.array([k] * len(at), pa.int32()), pa.array([v.tobytes() for v in got], pa.binary())], names=names)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = inverse = product = None
        for b in batches:
            out = []
            for case, seg, k, found in b.itertuples(index=False):
                m, p = methods[k]
                n, v = p["length"], np.frombuffer(found)
                if seg < 0:
                    weights = v[:n]
                    if m == "rls":
                        inverse = np.linalg.inv(v[n:].reshape(n, n))
                        product = inverse @ weights
                    continue
                if m == "nlms":
                    out.append((case, seg, k, weights.tobytes()))
                    v = v.reshape(n + 1, n)
                    weights = v[0] + weights @ (v[1:] - v[0])
                else:
                    matrix = np.linalg.inv(inverse)
                    out.append((case, seg, k, (matrix @ product).tobytes() + matrix.tobytes()))
                    v = v.reshape(n, n + 2)
                    inverse, product = v[0, 0] * inverse + v[:, 2:], v[0, 0] * product + v[:, 1]
            yield pd.DataFrame(out, columns=names)

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begun, case = b.column("begun").to_pylist(), b.column("case")
            lists = [b.column(c) for c in ("sizes", *order)]
            for at, x, before in _stacks(b):
                some = [c.take(pa.array(at)) for c in lists]
                sizes = some[0].flatten().to_numpy()
                cases = case.take(pa.array(np.repeat(at, some[0].value_lengths().to_numpy())))
                for k, (m, p) in enumerate(methods):
                    n, s = p["length"], _state(m, p, before)
                    given = np.stack([np.frombuffer(begun[i][k]) for i in at])
                    s["weights"][:] = given[:, :n]
                    if m == "rls":
                        s["p"][:] = given[:, n:].reshape(-1, n, n)
                        s["capped"] = np.zeros(len(at), bool)
                    y = adaptive.process(m, p, s, x, fs)
                    capped = np.repeat(s.get("capped", np.zeros(len(at), bool)), some[0].value_lengths().to_numpy())
                    y = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), y.reshape(-1))
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(sizes), pa.int32()), cases, *[c.flatten() for c in some[1:]], y, pa.array(capped)], names=["setting", "case", *order, "samples", "capped"])

    names, kinds = ["case", "seg", "setting", "found"], [pa.string(), pa.int64(), pa.int32(), pa.binary()]
    schema = "case string, seg long, setting int, found binary"
    heads = numbered.where(F.col("_upto") - F.col("_n") < warm).groupBy("case").agg(F.slice(flat(F.array_sort(F.collect_list(F.struct("_rank", "samples")))), 1, max(warm, 1)).alias("x"))
    if not warm:
        heads = numbered.select("case").distinct().withColumn("x", F.array().cast("array<double>"))
    found = segments.mapInArrow(maps, schema).union(heads.mapInArrow(warmed, schema))
    begun = found.repartition("case", "setting").sortWithinPartitions("case", "setting", "seg").mapInPandas(scan, schema)
    begun = begun.groupBy("case", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("setting", "found"))), lambda v: v["found"]).alias("begun"))
    kinds_of = dict(segments.dtypes)
    out = ", ".join(["setting int, case string", *[f"{c} {kinds_of[c][6:-1]}" for c in order], "samples array<float>, capped boolean"])
    return segments.join(begun, ["case", "seg"]).mapInArrow(filtered, out)
