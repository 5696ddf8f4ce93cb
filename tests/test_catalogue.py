"""Every registered core query against its SQL twin."""

import math
import os

import duckdb
import pytest

from cadenza.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    return (1, repr(float(v))) if isinstance(v, int | float) and not isinstance(v, bool) else (2, str(v))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = [tuple(plain(v) for v in (r[c] for c in sorted(df.columns))) for r in df.collect()]
    assert rows
    if sql := catalogue.oracle_sql().get(name):
        rel = duck.sql(sql)
        assert sorted(rel.columns) == sorted(df.columns)
        at = [rel.columns.index(c) for c in sorted(df.columns)]
        assert sorted(rows) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
