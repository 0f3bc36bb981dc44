"""Every query against DuckDB running its SQL on the same tables."""

import os

import duckdb
import pytest

from quarrydex import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(round(v, 8)) if isinstance(v, float) else str(v)


def rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    mine = df.collect()
    if name in catalog.ORACLES:
        theirs = duck.sql(catalog.ORACLES[name])
        assert sorted(df.columns) == sorted(theirs.columns)
        assert rows(mine, df.columns) == rows(theirs.fetchall(), theirs.columns)
    else:
        assert mine
