import numpy as np

from wavemill.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def brute(rows, k=5):
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % 50 == 0:
            near = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), j) for b, (j, v) in enumerate(ok) if b != a)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=12).astype(np.float32).tolist(), 0, "", "") for i in range(400)]
    same = rng.normal(size=12).astype(np.float32).tolist()
    rows += [(1000 + i, same, 0, "", "") for i in range(150)]  # ties, more than k, at the highest scores
    rows += [(2000, None, 0, "", ""), (2050, [float("nan")] * 12, 0, "", ""), (2051, [None] * 12, 0, "", ""), (2052, [float("inf")] * 12, 0, "", ""), (None, same, 0, "", ""), (2100, [], 0, "", ""), (2150, [1.0, 2.0], 0, "", "")]
    rows += [rows[3], rows[50]]
    df = spark.createDataFrame(rows, SCHEMA)
    for blocks in ({}, {"rows_per_block": 37, "queries_per_block": 3, "slices": 5}):
        got = topk.search(df, lambda i: i % 50 == 0, **blocks)
        assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows)


def test_most_entries_are_never_looked_up(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(10, 32))
    rows = [(i, (centre[i % 10] + 0.3 * rng.normal(size=32)).astype(np.float32).tolist(), 0, "", "") for i in range(2000)]
    counts = {}
    got = topk.search(spark.createDataFrame(rows, SCHEMA), lambda i: i % 50 == 0, rows_per_block=300, queries_per_block=16, counts=counts)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert 0 < counts["looked_up"] <= counts["named"] < 40 * 2000 / 5


def test_repeated_rows(spark):
    rows = [(50, [1.0, 2.0], 0, "", "")] * 9 + [(7, [3.0, 1.0], 0, "", "")] * 8 + [(100, [1.0, 2.0], 0, "", "")]
    got = topk.search(spark.createDataFrame(rows, SCHEMA), lambda i: i % 50 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_many_rows_of_one_query_id_are_many_tasks(spark):
    rng = np.random.default_rng(4)
    rows = [(50, rng.normal(size=3).astype(np.float32).tolist(), 0, "", "") for _ in range(20)] * 500 + [(i, rng.normal(size=3).astype(np.float32).tolist(), 0, "", "") for i in range(51, 90)]
    seen = []
    kept = topk.kept

    def watch(df):
        out = kept(df)
        if "q_block" in df.columns and "q_parts" in df.columns and "bounds" not in df.columns:
            seen.append([r["q_n"] for r in out.select("q_n").collect()])
        return out

    topk.kept = watch
    try:
        got = topk.search(spark.createDataFrame(rows, SCHEMA), lambda i: i % 50 == 0, queries_per_block=1024).groupBy("rank").count().collect()
    finally:
        topk.kept = kept
    assert {(r["rank"], r["count"]) for r in got} == {(k, 10_000) for k in range(1, 6)}
    assert len(seen[0]) >= 10 and sum(seen[0]) == 10_000 and max(seen[0]) <= 1024


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 0, "", ""), (50, [2.0], 0, "", "")], SCHEMA)
    assert sorted(tuple(r) for r in topk.search(df, lambda i: i % 50 == 0).collect()) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
    assert topk.search(df.limit(1), lambda i: i % 50 == 0).count() == 0
    assert topk.search(df.limit(0), lambda i: i % 50 == 0).count() == 0
