import hashlib

import numpy as np
import pytest

from wavemill.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string"


def brute(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~"
    centre = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centre))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centre)):
            of = [v for (_, v), c in zip(kept, own, strict=True) if c == j]
            if of:
                centre[j] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {j: sum(d for _, c, d in found if c == j) for j in range(len(centre))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in found), key=str)


def run(spark, rows, counts=None, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    got = centroids.inertias(*centroids.cluster(df, counts=counts, **options))
    return sorted((tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize("bits", [1, 3, 6, 8])
def test_against_brute_force(spark, bits):
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(6, 7))
    rows = [(i, (middle[i % 6] + 0.5 * rng.normal(size=7)).astype(np.float32).tolist(), 0, "") for i in range(400)]
    rows += [(1000 + i, rows[3][1], 0, "") for i in range(150)] + [rows[5]] * 3  # one hot vector, repeated rows
    rows += [(None, rows[7][1], 0, ""), (2, None, 0, ""), (3, [float("nan")] * 7, 0, ""), (4, [None] * 7, 0, ""), (5, [1.0] * 6, 0, ""), (6, [1.0] * 8, 0, ""), (7, [], 0, "")]
    assert run(spark, rows, k=9, rounds=3, dims=7, bits=bits) == brute(rows, 9, 3, 7)


def test_ties_equal_centroids_and_empty_clusters(spark):
    rows = [(i, [float(i % 3), 0.0], 0, "") for i in range(60)]
    assert run(spark, rows, k=10, rounds=2, dims=2) == brute(rows, 10, 2, 2)
    line = [(i, [(i % 9) / 256, 0.0], 0, "") for i in range(90)]  # many vectors half-way between centroids
    assert run(spark, line, k=5, rounds=4, dims=2) == brute(line, 5, 4, 2)


def test_few_none_and_huge(spark):
    rows = [(1, [1.0, 2.0], 0, ""), (2, [1.0, -2.0], 0, "")]
    assert run(spark, rows, dims=2) == brute(rows, 40, 5, 2)
    assert run(spark, rows, dims=3) == [] == run(spark, [])
    huge = [(i, [1e7 * (i % 5), -3e6 * (i % 7)], 0, "") for i in range(40)]
    fits = lambda v: v if v < 2**63 else None
    assert run(spark, huge, k=6, rounds=3, dims=2) == [(i, c, fits(d), fits(own), fits(total), sha) for i, c, d, own, total, sha in brute(huge, 6, 3, 2)]


def test_separate_clusters_stay_closed(spark):
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(4, 64)) * 0.5
    rows = [(i, (middle[i % 4] + 0.02 * rng.normal(size=64)).astype(np.float32).tolist(), 0, "") for i in range(800)]
    counts = {}
    assert run(spark, rows, counts, k=4) == brute(rows, 4, 5, 64)
    assert all(c["rows"] == 800 for c in counts.values())


def test_cells_hold_what_they_say():
    rng = np.random.default_rng(4)
    x = rng.integers(-90, 90, (500, 5))
    cells = centroids.Cells([sorted(np.quantile(x[:, j], np.linspace(0, 1, 9)[1:-1]).astype(int)) for j in range(5)], x.min(0).tolist(), x.max(0).tolist())
    codes = cells.codes(x)
    assert all((cells.low[j][codes[:, j]] <= x[:, j]).all() and (x[:, j] <= cells.high[j][codes[:, j]]).all() for j in range(5))
    for bits in (3, 5, 8):
        packed = centroids.pack(codes, bits)
        assert packed.shape[1] == (5 * bits + 7) // 8 and (centroids.unpack(packed, bits, 5) == codes).all()
    judge = centroids.Judge(cells, rng.integers(-90, 90, (12, 5)).tolist())
    exact = ((x[:, None] - judge.exact[None].astype(int)) ** 2).sum(2)
    may = judge.left(codes)
    assert (may | (exact > exact.min(1)[:, None])).all()  # whatever is nearest is left
