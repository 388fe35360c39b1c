import hashlib
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from wavemill.llm import sharding

SCHEMA = "doc_id long, text string, size string, shard string"


def test_cases_and_groups(spark):
    rows = [(i, f"text {i} " * (1 + i % 7), "s", "x") for i in range(200)] + [(None, None, None, None), (None, "", None, None), (7, "same", "s", "x"), (7, "same", "s", "x"), (8, "same", "s", "x"), (900, "long " * 3000, "s", "x")]
    got = sharding.pack(spark.createDataFrame(rows, SCHEMA), shards=4).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for text in ("same", ""):
        assert len({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(text.encode())}) == 1
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_bytes_are_even_with_a_hot_group(spark):
    rows = [(i, "hot text of one third of all rows", "", "") for i in range(400)] + [(1000 + i, f"{i} " * (i % 60), "", "") for i in range(800)]
    got = sharding.pack(spark.createDataFrame(rows, SCHEMA), shards=8).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.02 * sum(sizes) / 8 + 200


def sizes_of(got, shards):
    by = Counter()
    for r in got:
        by[r["shard"]] += r["size"]
    assert set(by) <= set(range(shards))
    return [by[s] for s in range(shards)]


def test_repeated_rows_are_split(spark):
    rows = [(7, "the very same row, many times over", "", "")] * 4000 + [(i, f"{i} " * (i % 60), "", "") for i in range(4000)]
    sizes = sizes_of(sharding.pack(spark.createDataFrame(rows, SCHEMA)).collect(), 16)
    assert max(sizes) < 1.02 * sum(sizes) / 16 and min(sizes) > 0.98 * sum(sizes) / 16


def test_a_group_that_fits_stays_whole(spark):
    rows = [(i, "boiler", "", "") for i in range(400)] + [(1000 + i, f"{i} " + "word " * 40, "", "") for i in range(9000)] + [(20_000 + i, "large " * 3500, "", "") for i in range(5)]
    got = sharding.pack(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(len({r["shard"] for r in got if low <= r["doc_id"] < high}) == 1 for low, high in ((0, 400), (20_000, 20_005)))
    sizes = sizes_of(got, 16)
    assert max(sizes) < 1.02 * sum(sizes) / 16 and min(sizes) > 0.98 * sum(sizes) / 16


def test_small_groups_are_balanced_in_every_dimension(spark):
    """Small groups in bundles (uneven by 2 % and 3 % without directions): short and long texts, sparse and rich ones; all three sums come out even."""
    kinds = [lambda i: f"w{i}", lambda i: f"{i} " + "a b c d e f g h " * 3, lambda i: f"{i}" + "x" * 150, lambda i: f"{i} word " * 12]
    rows = [(i, kinds[i % 4](i), "", "") for i in range(12_000)]
    got = sharding.pack(spark.createDataFrame(rows, SCHEMA), shards=4, fine=4, bundles=512).groupBy("shard").agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).collect()
    for k in (1, 2, 3):
        sums = [r[k] for r in got]
        assert len(sums) == 4 and max(sums) - min(sums) < 0.02 * sum(sums) / 4


def brute(texts, shards):
    """Shard of each distinct text, placed one by one in plain loops."""
    items = {t: [0, 0, 0] for t in texts}
    for t in texts:
        for k, x in enumerate((len(t.encode()) + 1, len(t.split()), 1)):
            items[t][k] += x
    total = [sum(v[k] for v in items.values()) for k in range(3)]
    share = {t: [v[k] / max(total[k], 1) * (2, 1, 1)[k] for k in range(3)] for t, v in items.items()}
    room = [[sum(d[k] for d in share.values()) / shards for k in range(3)] for _ in range(shards)]
    where = {}
    for t in sorted(share, key=lambda t: (-max(share[t]), hashlib.md5(t.encode()).hexdigest())):
        fit = [s for s in range(shards) if all(room[s][k] >= share[t][k] - 1e-12 for k in range(3))]
        fit = fit or [s for s in range(shards) if room[s][0] >= share[t][0] - 1e-12] or [max(range(shards), key=lambda s: (room[s][0], -s))]
        dot = {s: sum(room[s][k] * share[t][k] for k in range(3)) for s in fit}
        where[t] = next(s for s in fit if dot[s] >= max(dot.values()) - 1e-15)
        room[where[t]] = [room[where[t]][k] - share[t][k] for k in range(3)]
    return where


def test_against_placement_one_by_one(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(("a", "word", "another", "incomprehensibilities")) for _ in range(rng.randrange(1, 90))) for _ in range(70)]
    texts += [rng.choice(texts) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    got = sharding.pack(df, shards=5, fine=10**6).collect()
    want = brute(texts, 5)
    assert {r["doc_id"]: r["shard"] for r in got} == {i: want[t] for i, t in enumerate(texts)}


def test_empty(spark):
    assert sharding.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_placement_prefers_residual_capacity():
    where = sharding.place([(4, 1, 1), (4, 1, 1), (1, 4, 1), (1, 4, 1)], 2)
    assert where[0] != where[1] and where[2] != where[3]
    assert sharding.place([], 3) == []
