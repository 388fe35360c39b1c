import numpy as np
import pytest

from wavemill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string"
BAD = [(9001, None), (9002, [float("nan")] * 6), (9003, [None] * 6), (9004, [float("inf")] + [0.0] * 5)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "", "") for i, v in rows], SCHEMA)


def whole(rows, dims):
    out = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return [(i, np.concatenate([x, np.zeros(dims - len(x), int)])) for i, x in out]


def run(spark, rows):
    df = frame(spark, rows)
    return whitening.whiten(df, whitening.fit(df)).collect()


def test_against_eigenvectors_of_the_covariance(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(6, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]
    rows = [(i, (rng.normal(size=6) @ mix.T + 5).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [rows[1], (None, rows[2][1]), (1500, [1.0, 2.0])] + BAD
    got = run(spark, rows)
    kept = whole(rows, 6)
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {n}
    deviations = sorted(int(((n * x - s) ** 2).sum()) for _, x in kept)
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == deviations
    for k in range(4):
        own = {r["vec_id"]: r["whitened"] for r in got if r["component"] == k + 1}
        want = {i: (x - s / n) @ vectors[:, k] / np.sqrt(values[k]) for i, x in kept}
        sign = np.sign(own[0] * want[0])
        assert own == pytest.approx({i: sign * v for i, v in want.items()}, rel=1e-9, abs=1e-9)
        assert [r["explained"] for r in got if r["component"] == k + 1] == pytest.approx([values[k] / values.sum()] * len(kept), rel=1e-10)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10


def test_jacobi_on_the_factor_of_graded_and_deficient_scatters():
    rng = np.random.default_rng(1)
    for scale in (np.logspace(0, -7, 12), np.r_[np.ones(5), np.zeros(7)]):
        q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
        scatter = (q * scale) @ q.T
        scatter = (scatter + scatter.T) / 2
        factor = whitening.cholesky(scatter)
        assert np.allclose(factor @ factor.T, scatter, atol=1e-14)
        components, values = whitening.jacobi(factor)
        rank = int((scale > 0).sum())
        assert len(values) >= rank and values[:rank] == pytest.approx(np.sort(scale)[::-1][:rank], rel=1e-6)
        assert np.allclose(components.T @ components, np.eye(len(values)), atol=1e-12)
        assert np.allclose((components * values) @ components.T, scatter, atol=1e-12)


def test_far_from_the_origin(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * [1, 0.1, 0.01] + [60000, -60000, 1]).astype(np.float32).tolist()) for i in range(200)]
    got = run(spark, rows)
    x = np.unique(np.array([v for _, v in whole(rows, 3)]), axis=0).astype(object)
    n, c = len(x), len(x) * x - x.sum(0)
    exact = np.array((c.T @ c) / n**3, float)
    values = np.linalg.eigvalsh(exact)[::-1]
    assert {r["component"] for r in got} == {1, 2, 3} and got[0]["identity_error"] < 1e-6
    assert sorted({r["explained"] for r in got}, reverse=True) == pytest.approx((values / values.sum()).tolist(), rel=1e-8)


def test_few_constant_and_huge(spark):
    assert run(spark, []) == run(spark, BAD) == run(spark, [(1, [1.0, 2.0])]) == run(spark, [(i, [3.0, 4.0]) for i in range(9)]) == run(spark, [(1, []), (2, [])]) == []
    line = run(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0])])
    assert [(r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 9), r["explained"]) for r in line] == [(1, 2, 256**2, 1.0, 1.0)] * 3
    huge = run(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])])
    assert {r["deviation"] for r in huge} >= {None} and len(huge) in (3, 6)
