"""Every registered query against its DuckDB twin, on the smallest tables."""

import math

import duckdb
import pytest
from conftest import SF

from wavemill import config, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"loso_rf", "loso_svm", "loso_nested", "label_shuffle"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert table(got.columns, got.collect()) == table(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - SLOW))
def test_runs_without_a_twin(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_every_setting_of_the_grid_is_screened(spark):
    got = {r["tag"] for r in queries.QUERIES["screen_settings"](spark, SF).collect()}
    assert got == {config.tag(m, p) for m, p in config.grid()} and len(got) == 20


def test_models_and_bootstrap_have_the_sizes_of_the_reference(spark, monkeypatch):
    given = []
    monkeypatch.setattr(queries.loso, "_scored", lambda kind, fit, score, wanted, params, *a: given.append(params) or (_ for _ in ()).throw(StopIteration))
    for name in ("loso_rf", "label_shuffle"):
        with pytest.raises(StopIteration):
            queries.QUERIES[name](spark, SF)
    assert given == [[{"n_estimators": 200, "max_depth": None, "min_samples_leaf": 1}]] * 2
    given.clear()
    monkeypatch.setattr(queries.compare, "arms", lambda *a, n_boot=10_000, **o: given.append(n_boot))
    queries.QUERIES["arm_comparison"](spark, SF)
    assert given == [10_000]
