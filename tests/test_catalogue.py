"""Every query of the catalogue against its SQL in DuckDB."""

import os
from decimal import Decimal

import duckdb
import pytest

from tidewater.plans.catalogue import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    return sorted([tuple(round(float(x), 5) if isinstance(x, float | Decimal) else x for x in r) for r in rows], key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = plain(tuple(r[c] for c in cols) for r in df.collect())
    ran = con.execute(SQL[name])
    names = [x[0] for x in ran.description]
    want = plain(tuple(r[names.index(c)] for c in cols) for r in ran.fetchall())
    assert sorted(names) == cols
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(a == b or (isinstance(a, float) and abs(a - b) <= 2e-5 * max(1, abs(b))) for a, b in zip(g, w, strict=True)), (g, w)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, con, name):
    assert QUERIES[name](spark, DATA).count() > 0
