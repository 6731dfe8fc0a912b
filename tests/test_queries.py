"""Registered queries of the engine against their SQL on the smallest tables."""

import duckdb
import pytest

from spanledger import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return float(f"{v:.8g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    res = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in res.description]
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in res.fetchall()), key=repr)
    assert sorted(names) == cols and rows == want
