"""Causal adaptive filters with carried state, over ordered chunks of all channels of a case.

Channels are independent of each other, but a case's channels are filtered side by
side: a step over time is then a few array operations for all of them. The state
goes from one chunk to the next, so chunking never changes the output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import WARM_START_S, method_params, tag
from ..operators.arrays import scanned
from ..shared import partitions


def start(method: str, params: dict, channels: int = 1) -> dict[str, np.ndarray]:
    """The state before any sample; the first axis is the channel."""
    if method == "kalman":
        return {"tracker": np.zeros((channels, 5))}  # begun, log amplitude, variance, sum of squares and count of the open block
    n = params["length"]
    state = {"weights": np.zeros((channels, n)), "history": np.zeros((channels, n))}
    return state | ({"p": np.tile(np.eye(n) / params["delta"], (channels, 1, 1))} if method == "rls" else {})


def process(method: str, params: dict, state: dict[str, np.ndarray], x: np.ndarray, fs: float) -> np.ndarray:
    """Output of one chunk, (channels, samples) or one channel; ``state`` moves on in place."""
    x = np.asarray(x, float)
    if not np.isfinite(x).all():
        raise ValueError("the input holds NaN or infinite values")
    out = {"nlms": _nlms, "rls": _rls, "kalman": _kalman}[method](params, state, np.atleast_2d(x), fs)
    return out[0] if x.ndim == 1 else out


def _pasts(s: dict, x: np.ndarray):
    """For each sample the samples before it, the latest first; at the end the history moves on."""
    n = s["history"].shape[1]
    line = np.concatenate([s["history"][:, ::-1], x], axis=1)
    for i in range(x.shape[1]):
        yield i, line[:, i : i + n][:, ::-1]
    s["history"][:] = line[:, line.shape[1] - n :][:, ::-1]


def _nlms(p: dict, s: dict, x: np.ndarray, fs: float) -> np.ndarray:
    w, out = s["weights"], np.empty(x.shape)
    for i, u in _pasts(s, x):
        e = out[:, i] = x[:, i] - np.einsum("cl,cl->c", w, u)
        power = np.einsum("cl,cl->c", u, u)
        w += np.where(power > p["eps"], p["mu"] * e / (p["eps"] + power), 0.0)[:, None] * u
    return out.astype(np.float32)


def _rls(p: dict, s: dict, x: np.ndarray, fs: float) -> np.ndarray:
    w, m, out = s["weights"], s["p"], np.empty(x.shape)
    cap, lam = p["cap_factor"] * w.shape[1] / p["delta"], p["forgetting"]
    for i, u in _pasts(s, x):
        e = out[:, i] = x[:, i] - np.einsum("cl,cl->c", w, u)
        mu = np.einsum("ckl,cl->ck", m, u)
        denominator = lam + np.einsum("cl,cl->c", u, mu)
        learns = (np.einsum("cl,cl->c", u, u) > p["eps"]) & (denominator > 1e-12)
        if not learns.any():
            continue
        whole = learns.all()
        if not whole:
            e, denominator = np.where(learns, e, 0.0), np.where(learns, denominator, 1.0)
        w += e[:, None] * (mu / denominator[:, None])
        # products of two entries are the same on both sides of the diagonal: a difference between them would grow by 1 / lam a sample
        new = (m - mu[:, :, None] * mu[:, None, :] / denominator[:, None, None]) / lam
        trace = np.einsum("cll->c", new)
        over = trace > cap
        if "capped" in s:  # asked for by those who must know
            s["capped"] |= learns & over
        if over.any():
            new *= np.where(over, cap / np.where(over, trace, 1.0), 1.0)[:, None, None]
        if whole:
            m[:] = new
        else:
            m[learns] = new[learns]
    return out.astype(np.float32)


def _kalman(p: dict, s: dict, x: np.ndarray, fs: float) -> np.ndarray:
    v, block, out = s["tracker"], round(p["block_s"] * fs), np.empty(x.shape)
    at = 0
    while at < x.shape[1]:
        to = min(x.shape[1], at + block - int(v[0, 4]))  # all channels are equally far in their block
        out[:, at:to] = x[:, at:to] * np.where(v[:, 0] > 0, np.exp(-v[:, 1]), 1.0)[:, None]
        v[:, 3] += (x[:, at:to] ** 2).sum(axis=1)
        v[:, 4] += to - at
        if v[0, 4] >= block:
            z = np.clip(0.5 * np.log(v[:, 3] / block + 1e-6), np.log(p["min_rms"]), np.log(p["max_rms"]))
            if v[0, 0]:
                ahead = v[:, 2] + p["q_over_r"] * p["r"]
                k = ahead / (ahead + p["r"])
                v[:, 1], v[:, 2] = v[:, 1] + k * (z - v[:, 1]), (1 - k) * ahead
            else:
                v[:, 0], v[:, 1], v[:, 2] = 1.0, z, p["r"]
            v[:, 3:] = 0.0
        at = to
    return out.astype(np.float32)


def settle(method: str, state: dict[str, np.ndarray]) -> None:
    """After a warm start: what was learned stays, what the last samples left goes."""
    if method == "kalman":
        state["tracker"][:, 3:] = 0.0
    else:
        state["history"][:] = 0.0


STATE = "weights array<double>, history array<double>, p array<double>, tracker array<double>"
PARTS = ("weights", "history", "p", "tracker")


def run(signals: DataFrame, method: str, params: dict | None = None, fs: float = 256.0, warm_start_s: float = WARM_START_S, order: tuple[str, ...] = ("file_order", "chunk_idx"), initial: DataFrame | None = None) -> DataFrame:
    """Filter chunks (case, channel, file, file_order, chunk_idx, samples) in order, with the state of each (case, channel).

    The group is a case, read as a stream of Arrow batches sorted by the shuffle,
    so a task holds a batch, one chunk of all channels, and the state, not the case.
    The number of tasks is given: a filter's time goes by samples, so tasks are not merged by their few bytes.
    The first ``warm_start_s`` seconds are run once before any output. A chunk that
    fails (values that are not finite, channels that differ from the case's first chunk,
    lengths that differ) gives status ``failed``; what follows it in its case is
    ``not_run``. Each row carries the state after its chunk; ``initial`` (see
    ``states``) goes on from such states in place of a warm start, for later chunks
    of the same cases and setting.
    """
    p = method_params(method, params)
    warm = round(warm_start_s * fs)
    cols = ["case", "channel", "file", *order]
    rows = signals.select(*cols, "samples")
    if initial is not None:
        own = initial.where(F.col("setting") == tag(method, params, warm_start_s)).select("case", "channel", *PARTS)
        rows = rows.join(own, ["case", "channel"], "left")
    else:
        rows = rows.select("*", *[F.lit(None).cast("array<double>").alias(k) for k in PARTS])
    sort = ["case", *order, "file", "channel"]
    rows = rows.select(*cols, "samples", *PARTS).repartition(max(partitions(signals.sparkSession), signals.sparkSession.sparkContext.defaultParallelism), "case").sortWithinPartitions(*sort)
    kinds = dict(rows.dtypes)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[list] = []
        case = names = state = None
        broken = ready = False
        held: list[list] = []  # chunks before the warm start is complete
        chunk: list = []  # rows of the chunk at hand

        def matrix(of: list) -> np.ndarray:
            if [r.channel for r in of] != names:
                raise ValueError("channels differ")
            if len({len(r.samples) for r in of}) > 1:
                raise ValueError("lengths differ")
            return np.stack([np.asarray(r.samples, float) for r in of])

        def filtered(of: list) -> None:
            nonlocal broken
            nothing = [None] * len(PARTS)
            if broken:
                out.extend([*[getattr(r, c) for c in cols], None, "not_run", None, None, None, *nothing] for r in of)
                return
            try:
                x = matrix(of)
                y = process(method, p, state, x, fs)
            except ValueError as e:
                broken = True
                out.extend([*[getattr(r, c) for c in cols], None, "failed", None, None, str(e), *nothing] for r in of)
                return
            rms = lambda v: float(np.sqrt(np.mean(np.square(v, dtype=float)))) if len(v) else None
            for i, r in enumerate(of):
                own = [state[k][i].reshape(-1).copy() if k in state else None for k in PARTS]
                out.append([*[getattr(r, c) for c in cols], y[i], "success", rms(x[i]), rms(y[i]), None, *own])

        def begin() -> None:
            """Warm up on what was held back, then run it."""
            nonlocal ready
            ready = True
            try:
                head = np.concatenate([matrix(c) for c in held], axis=1)[:, :warm]
                process(method, p, state, head, fs)
                settle(method, state)
            except ValueError:  # the chunk itself will say what is wrong
                for k, v in start(method, p, len(names)).items():
                    state[k] = v
            for c in held:
                filtered(c)
            held.clear()

        def end_chunk() -> None:
            nonlocal case, names, state, broken, ready
            if not chunk:
                return
            if chunk[0].case != case:
                end_case()
                case, names, broken = chunk[0].case, [r.channel for r in chunk], False
                state = start(method, p, len(names))
                given = all(getattr(r, k) is not None for r in chunk for k in state)
                ready = given or warm == 0
                if given:
                    for k, v in state.items():
                        state[k] = np.stack([np.array(getattr(r, k), float).reshape(v.shape[1:]) for r in chunk])
            if ready:
                filtered(list(chunk))
            else:
                held.append(list(chunk))
                if sum(len(c[0].samples) for c in held) >= warm:
                    begin()
            chunk.clear()

        def end_case() -> None:
            if held:
                begin()

        def frame() -> pd.DataFrame:
            df = pd.DataFrame(out, columns=[*cols, "samples", "status", "rms_in", "rms_out", "error", *PARTS])
            out.clear()
            return df

        for b in batches:
            for row in b.itertuples(index=False):
                if chunk and [getattr(row, c) for c in ("case", "file", *order)] != [getattr(chunk[0], c) for c in ("case", "file", *order)]:
                    end_chunk()
                chunk.append(row)
            if out:
                yield frame()
        end_chunk()
        end_case()
        if out:
            yield frame()

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in cols], "samples array<float>", "status string", "rms_in double", "rms_out double", "error string", STATE])
    return rows.mapInPandas(go, schema)


def states(filtered: DataFrame, method: str, params: dict | None = None, warm_start_s: float = WARM_START_S, order: tuple[str, ...] = ("file_order", "chunk_idx")) -> DataFrame:
    """The last state of each (case, channel) with the name of its setting: what a later run can go on from. Cases that failed have none."""
    last = filtered.groupBy("case", "channel").agg(F.max_by(F.struct("status", *PARTS), F.struct(*order)).alias("s"))
    return last.where("s.status = 'success'").select("case", "channel", F.lit(tag(method, params, warm_start_s)).alias("setting"), *[F.col(f"s.{k}") for k in PARTS])


def tracked(z: Column, q_over_r: float, r: float = 1.0) -> Column:
    """The log-amplitude recursion over an array of block log-RMS values, as a fold in the JVM: the estimate after each block."""
    def step(at: Column, v: Column) -> tuple[dict[str, Column], Column, Column]:
        ahead = at["p"] + q_over_r * r
        k = ahead / (ahead + r)
        s = F.when(at["s"].isNull(), v).otherwise(at["s"] + k * (v - at["s"]))
        p = F.when(at["s"].isNull(), F.lit(r)).otherwise((1 - k) * ahead)
        return {"s": s, "p": p}, s, F.lit(True)

    return scanned(z, {"s": F.lit(None).cast("double"), "p": F.lit(r)}, step, "double")
