"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from ledgerlens.jobs import catalog

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    return (1, repr(float(v))) if isinstance(v, (int, float)) and not isinstance(v, bool) else (2, str(v))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = catalog.queries()[name](spark, D)
    cols = sorted(got.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in got.select(*cols).collect())
    found = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_flagship_has_rows(spark):
    assert catalog.flagship(spark, D).count() > 0
