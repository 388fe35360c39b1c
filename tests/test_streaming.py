import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from wavemill.config import method_params, tag
from wavemill.functions import adaptive, segmented
from wavemill.operators import events
from wavemill.plans import screen
from wavemill.plans.bindings import predictions
from wavemill.streaming import alarms, filters


def batches(spark, df, path, order, n=3):
    for i in range(n):
        df.where(F.col("_b") == i).drop("_b").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("_b").schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_raises_the_batch_alarms(spark, tmp_path):
    alarms.use_rocksdb(spark)
    pred = predictions(spark, SF).where("patient < 4").select("file", "start_sample", "y_pred")
    third = F.least(F.floor(F.col("start_sample") / 4096), F.lit(2)).alias("_b")
    stream = batches(spark, pred.select("*", third), str(tmp_path / "in"), ["start_sample"])
    run(alarms.alarms(stream, min_consecutive=2, merge_gap=1024, refractory=4096), "alarms", tmp_path)
    got = {tuple(r) for r in spark.table("alarms").collect()}
    found = events.merged_alarms(events.runs(pred, ["file"], F.col("y_pred") == 1, 512), ["file"], 1024, 512, 2, 1024)
    want = {(r["file"], r["raise_sample"]) for r in events.refractory_alarms(found, ["file"], 4096).collect()}
    assert got == want and want


CHUNKS = "case string, channel string, file string, file_order int, chunk_idx int, samples array<double>"


def signal(spark, bad=()):
    rng = np.random.default_rng(6)
    rows = []
    for case, channel in (("c", "A"), ("c", "B"), ("d", "A")):
        x = rng.normal(size=480).cumsum()
        for i in range(8):
            part = x[60 * i : 60 * i + 60].tolist()
            if (case, i) in bad:
                part[3] = float("nan")
            rows.append((case, channel, f"f{i // 2}", i // 2, i % 2, part))
    return spark.createDataFrame(rows, CHUNKS)


def outcome(df):
    return sorted((r["case"], r["channel"], r["file_order"], r["chunk_idx"], r["status"], r["samples"]) for r in df.collect())


@pytest.mark.parametrize("method", ["nlms", "rls", "kalman"])
def test_streams_filter_as_batches_do(spark, tmp_path, method):
    alarms.use_rocksdb(spark)
    df, options = signal(spark), {"fs": 32.0, "warm_start_s": 5.0}  # a warm start of more than two chunks, which come in two batches
    want = outcome(adaptive.run(df, method, **options))
    numbered = df.withColumn("_b", F.col("file_order"))
    run(filters.filtered(batches(spark, numbered, str(tmp_path / "in"), [], 4), method, **options), f"whole_{method}", tmp_path)
    assert outcome(spark.table(f"whole_{method}")) == want
    # the same from the states of a batch run over the first two files, and a batch run from those of the stream
    first = adaptive.run(df.where("file_order < 2"), method, **options)
    later = df.where("file_order = 2").withColumn("_b", F.col("chunk_idx"))
    run(filters.filtered(batches(spark, later, str(tmp_path / "later"), [], 2), method, **options, initial=adaptive.states(first, method, warm_start_s=5.0)), f"later_{method}", tmp_path)
    streamed = spark.table(f"later_{method}")
    assert outcome(streamed) == [r for r in want if r[2] == 2]
    last = adaptive.run(df.where("file_order = 3"), method, **options, initial=adaptive.states(streamed, method, warm_start_s=5.0))
    assert outcome(last) == [r for r in want if r[2] == 3]


def test_streams_tell_of_bad_and_late_chunks(spark, tmp_path):
    alarms.use_rocksdb(spark)
    df = signal(spark, bad={("d", 4)}).where("channel = 'A'")
    order = F.when(F.col("case") == "c", F.when((F.col("file_order") == 1) & (F.col("chunk_idx") == 0), 1).otherwise(0)).otherwise(F.floor(F.col("file_order") / 2))
    run(filters.filtered(batches(spark, df.withColumn("_b", order), str(tmp_path / "in"), [], 2), "nlms", fs=32.0, warm_start_s=1.0), "odd", tmp_path)
    got = {(c, 2 * f + i): s for c, _, f, i, s, _ in outcome(spark.table("odd"))}
    assert {s for (c, i), s in got.items() if c == "c" and i != 2} == {"success"} and got["c", 2] == "late"
    assert [got["d", i] for i in range(8)] == ["success"] * 4 + ["failed"] + ["not_run"] * 3


def test_channels_without_a_whole_warm_start_are_held_back(spark, tmp_path):
    alarms.use_rocksdb(spark)
    df = signal(spark).where("case = 'd' and file_order = 0").withColumn("_b", F.col("chunk_idx"))
    run(filters.filtered(batches(spark, df, str(tmp_path / "in"), [], 2), "rls", fs=32.0, warm_start_s=60.0), "held", tmp_path)
    assert spark.table("held").count() == 0


def test_segments_filter_as_one_after_the_other_does(spark, monkeypatch):
    rng = np.random.default_rng(8)
    loud = rng.normal(size=(90, 16))
    quiet = np.where(np.arange(90)[:, None] < 12, loud, 0.02 * loud)  # RLS forgets until its cap holds
    rows = [(case, "C1", "all", 1, 3 * i, v.tolist()) for case, x in (("loud", loud), ("quiet", quiet), ("short", loud[:2])) for i, v in enumerate(x)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    settings = [("nlms", {"length": 8, "mu": 0.02}), ("rls", {"length": 8, "forgetting": 0.9995}), ("rls", {"length": 4, "forgetting": 0.9, "cap_factor": 5.0})]
    monkeypatch.setattr(segmented, "CHUNKS", 4)
    got, capped = {}, set()
    for r in segmented.run(chunks, settings, 16.0, 4.0).collect():
        got[r["setting"], r["case"], r["chunk_idx"]] = r["samples"]
        if r["capped"]:
            capped.add((r["setting"], r["case"]))
    assert len(got) == 3 * len(rows) and capped == {(2, "quiet")}
    for k, (method, params) in enumerate(settings):
        for r in adaptive.run(chunks, method, params, fs=16.0, warm_start_s=4.0).collect():
            if (k, r["case"]) not in capped:
                assert np.allclose(got[k, r["case"], r["chunk_idx"]], r["samples"], rtol=1e-5, atol=1e-6)
    # the screen takes capped cases one chunk after the other
    some = chunks.where("case = 'quiet'").unionByName(spark.createDataFrame([("odd", "C1", "all", 1, i, [1.0] * 15 + [2.0 + i]) for i in range(3)], CHUNKS))
    found = {(r["tag"], r["case"], r["chunk_idx"]): r["_f"] for r in screen._features_after(some, settings, 16.0).collect()}
    for method, params in settings:
        want = adaptive.run(some, method, params, fs=16.0, warm_start_s=4.0)
        for r in want.select("case", "chunk_idx", screen.cheap_features(16.0)("samples").alias("f")).collect():
            assert np.allclose(found.pop((tag(method, params), r["case"], r["chunk_idx"])), r["f"], rtol=1e-4)
    assert not found


def test_filters_of_many_short_cases_run_in_many_tasks(spark):
    rows = [(f"c{i}", "C1", "f", 0, 0, [float(i + k) for k in range(30)]) for i in range(64)]
    out = adaptive.run(spark.createDataFrame(rows, CHUNKS), "rls", {"length": 4}, fs=1.0, warm_start_s=20.0)
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_a_chunk_costs_two_calls_of_the_state_store():
    calls, store = [], {}

    class State:
        def __init__(self, name):
            self.name = name

        def get(self):
            calls.append("get")
            return iter(store.get("held", [])) if self.name == "held" else store.get("filter")

        def update(self, value):
            calls.append("update")
            store["filter"] = value

        def put(self, rows):
            calls.append("put")
            store["held"] = rows

        def clear(self):
            calls.append("clear")
            store.pop("held", None)

    class Handle:
        getValueState = getListState = staticmethod(lambda name, schema: State(name))

    def sent(i):
        calls.clear()
        chunk = pd.DataFrame({"file": ["f"], "file_order": [i], "chunk_idx": [0], "samples": [[float(i), 1.0, 2.0]]})
        return [r for df in made.handleInputRows(("c", "A"), iter([chunk]), None) for r in df["file_order"]], list(calls)

    made = filters.FilterProcessor("nlms", method_params("nlms", {"length": 4}), 1.0, 6)
    made.init(Handle())
    assert sent(0) == ([], ["get", "put", "update"])
    assert sent(1) == ([0, 1], ["get", "get", "clear", "update"])
    assert sent(2) == ([2], ["get", "update"])
