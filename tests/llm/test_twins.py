"""Every query with a DuckDB twin against it, on the smallest tables."""

import duckdb
import pytest
from conftest import SF

from wavemill.llm import queries

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    rows = lambda found: sorted(([plain(v) for v in r] for r in found), key=str)
    assert rows(got.select(*names).collect()) == rows([r[i] for i in at] for r in want.fetchall())
