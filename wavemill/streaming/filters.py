"""NLMS, RLS and the amplitude filter over streams of chunks, with the filter's state in the state store.

A key is one channel of a case. Its chunks are filtered as they come, and each
output row carries the state after it, as the batch filter's rows do: a stream can begin with the states of a
batch run (or of another stream), and a batch run can go on from those of a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import WARM_START_S, method_params, tag
from ..functions import adaptive

ORDER = ["file_order", "chunk_idx"]
OUT = f"case string, channel string, file string, file_order long, chunk_idx long, samples array<float>, status string, rms_in double, rms_out double, error string, {adaptive.STATE}"
NAMES = [c.split()[0] for c in OUT.split(", ")]
STATE = f"{adaptive.STATE}, ready boolean, broken boolean, file_order long, chunk_idx long"


class FilterProcessor(StatefulProcessor):
    """Filters the chunks of a channel in order; those before the warm start is complete are held back and then filtered first.

    A chunk that fails gives ``failed`` and stops its channel: what follows is ``not_run``. A chunk
    that comes after a later one was filtered is ``late`` and leaves the state as it is.
    """

    def __init__(self, method: str, params: dict, fs: float, warm: int):
        self.method, self.params, self.fs, self.warm = method, params, fs, warm

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.filter = handle.getValueState("filter", STATE)
        self.held = handle.getListState("held", "file string, file_order long, chunk_idx long, samples array<double>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        given = initialState.iloc[0]
        self.filter.update((*[None if given[c] is None else [float(v) for v in given[c]] for c in adaptive.PARTS], True, False, None, None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = adaptive.start(self.method, self.params)
        ready, broken, last = self.warm == 0, False, None
        if known := self.filter.get():  # each call of the state store is a round trip
            *parts, ready, broken, file_order, chunk_idx = known
            last = None if file_order is None else (file_order, chunk_idx)
            for c, v in zip(adaptive.PARTS, parts, strict=True):
                if v is not None:
                    state[c] = np.array(v, float).reshape(state[c].shape)
        out: list[tuple] = []

        def told(chunk, status: str, samples=None, rms_in=None, rms_out=None, error=None) -> None:
            own = [state[c][0].reshape(-1).tolist() if status == "success" and c in state else None for c in adaptive.PARTS]
            out.append((*key, chunk[0], int(chunk[1]), int(chunk[2]), samples, status, rms_in, rms_out, error, *own))

        def filtered(chunk) -> None:
            nonlocal broken, last
            if broken:
                return told(chunk, "not_run")
            x = np.asarray(chunk[3], float)
            try:
                y = adaptive.process(self.method, self.params, state, x, self.fs)
            except ValueError as e:
                broken = True
                return told(chunk, "failed", error=str(e))
            last = (int(chunk[1]), int(chunk[2]))
            rms = lambda v: float(np.sqrt(np.mean(np.square(v, dtype=float)))) if len(v) else None
            told(chunk, "success", y.tolist(), rms(x), rms(y))

        waiting = [] if ready or not known else [tuple(r) for r in self.held.get()]
        had = bool(waiting)
        arrived = pd.concat(rows)[["file", *ORDER, "samples"]].itertuples(index=False, name=None)
        for chunk in sorted(arrived, key=lambda c: c[1:3]):
            if last is not None and chunk[1:3] <= last:
                told(chunk, "late")
            elif ready:
                filtered(chunk)
            else:
                waiting.append(chunk)
        if not ready and sum(len(c[3]) for c in waiting) >= self.warm:
            waiting.sort(key=lambda c: c[1:3])
            try:
                adaptive.process(self.method, self.params, state, np.concatenate([np.asarray(c[3], float) for c in waiting])[: self.warm], self.fs)
                adaptive.settle(self.method, state)
            except ValueError:  # the chunk itself will say what is wrong
                state = adaptive.start(self.method, self.params)
            ready = True
            for chunk in waiting:
                filtered(chunk)
            waiting = []
        if waiting:
            self.held.put([(c[0], int(c[1]), int(c[2]), [float(v) for v in c[3]]) for c in waiting])
        elif had:
            self.held.clear()
        self.filter.update((*[state[c].reshape(-1).tolist() if c in state else None for c in adaptive.PARTS], ready, broken, *(last or (None, None))))
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def filtered(stream: DataFrame, method: str, params: dict | None = None, fs: float = 256.0, warm_start_s: float = WARM_START_S, initial: DataFrame | None = None) -> DataFrame:
    """A stream of chunks (case, channel, file, file_order, chunk_idx, samples) filtered, with the columns of ``adaptive.run``.

    ``initial`` (see ``adaptive.states``) takes the place of a warm start for the
    channels that it has. Chunks of a channel must arrive in order over batches, within one in any order. A channel is held back
    until it has its warm start; one that never gets there gives no rows.
    """
    p = method_params(method, params)
    keys = ["case", "channel"]
    rows = stream.select(*keys, "file", *[F.col(c).cast("long").alias(c) for c in ORDER], "samples")
    begin = None
    if initial is not None:
        begin = initial.where(F.col("setting") == tag(method, params, warm_start_s)).select(*keys, *adaptive.PARTS).groupBy(*keys)
    return rows.groupBy(*keys).transformWithStateInPandas(FilterProcessor(method, p, fs, round(warm_start_s * fs)), OUT, "Append", "None", initialState=begin)
