"""Alarms and amplitude tracking over streams of windows.

State is kept per recording (or user) by ``transformWithStateInPandas``, in the
RocksDB state store, and each batch of a key is put in order before it is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shared import new_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

ALARM = "file string, raise_sample long"
TRACK = "case string, block long, log_amplitude double"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class AlarmProcessor(StatefulProcessor):
    """Raises an alarm at the k-th positive window in a row, unless it merges with the run before or falls into the refractory time."""

    def __init__(self, window: int, step: int, min_consecutive: int, merge_gap: int, refractory: int):
        self.window, self.step, self.k, self.gap, self.refractory = window, step, min_consecutive, max(step, merge_gap), refractory

    def init(self, handle: StatefulProcessorHandle) -> None:
        # last window, length of the open run, last window of the last long run, last accepted alarm
        self.state = handle.getValueState("run", "last long, n long, long_end long, accepted long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        far = -(2**60)
        last, n, long_end, accepted = self.state.get() if self.state.exists() else (far, 0, far, far)
        raised = []
        for row in pd.concat(rows).sort_values("start_sample").itertuples():
            s = int(row.start_sample)
            n = (n + 1 if n and s - last == self.step else 1) if row.y_pred == 1 else 0
            last = s
            if n == self.k and s - long_end > self.gap:
                at = s + self.window
                if at - accepted >= self.refractory:
                    raised.append(at)
                    accepted = at
            if n >= self.k:
                long_end = s
        self.state.update((last, n, long_end, accepted))
        yield pd.DataFrame([(key[0], at) for at in raised], columns=["file", "raise_sample"])

    def close(self) -> None:
        pass


def alarms(stream: DataFrame, window: int = 1024, step: int = 512, min_consecutive: int = 1, merge_gap: int = 512, refractory: int = 0) -> DataFrame:
    """(file, raise_sample) as soon as each alarm is certain; windows of a recording must arrive in order over batches."""
    return stream.groupBy("file").transformWithStateInPandas(AlarmProcessor(window, step, min_consecutive, merge_gap, refractory), ALARM, "Append", "None")


class GainProcessor(StatefulProcessor):
    """Log amplitude after every whole block of samples of a key."""

    def __init__(self, block: int, q_over_r: float, r: float, low: float, high: float):
        self.block, self.q, self.r, self.low, self.high = block, q_over_r * r, r, np.log(low), np.log(high)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("track", "blocks long, s double, p double, ss double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        blocks, s, p, ss, n = self.state.get() if self.state.exists() else (0, 0.0, 0.0, 0.0, 0)
        out = []
        for v in pd.concat(rows).sort_values(["ts", "event_id"])["value"]:
            ss, n = ss + v * v, n + 1
            if n == self.block:
                z = min(max(0.5 * np.log(ss / n + 1e-6), self.low), self.high)
                if blocks:
                    ahead = p + self.q
                    gain = ahead / (ahead + self.r)
                    s, p = s + gain * (z - s), (1 - gain) * ahead
                else:
                    s, p = z, self.r
                out.append((key[0], blocks, float(s)))
                blocks, ss, n = blocks + 1, 0.0, 0
        self.state.update((blocks, float(s), float(p), float(ss), n))
        yield pd.DataFrame(out, columns=["case", "block", "log_amplitude"])

    def close(self) -> None:
        pass


def amplitudes(stream: DataFrame, block: int = 256, q_over_r: float = 1e-4, r: float = 1.0, low: float = 0.1, high: float = 1e4) -> DataFrame:
    """(case, block, log_amplitude) over a stream of (case, ts, event_id, value)."""
    return stream.groupBy("case").transformWithStateInPandas(GainProcessor(block, q_over_r, r, low, high), TRACK, "Append", "None")


def windowed_means(stream: DataFrame, length: str = "4 seconds", slide: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Mean and count of values in sliding event-time windows per case, for regularly sampled streams."""
    return stream.withWatermark("ts", late).groupBy("case", F.window("ts", length, slide)).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def drained(stream: DataFrame) -> DataFrame:
    """Run a stream over all that its source has now, and read what it wrote; files and checkpoint are in the shared folder."""
    spark = stream.sparkSession
    path = new_folder(spark)
    run = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
