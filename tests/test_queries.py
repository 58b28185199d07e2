"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from palimpsest import registry, store_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = registry.QUERIES | store_queries.QUERIES, registry.ORACLES | store_queries.ORACLES
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    r = db.execute(ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(x[i] for i in order)) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
