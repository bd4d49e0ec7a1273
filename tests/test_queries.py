"""Every query of the outline engine against its SQL twin."""

import os

import duckdb
import pytest

from vellum import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "orders", "documents", "pages"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    got = Q.queries()[name](spark, SF)
    want = duck.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    b = sorted(want.fetchall(), key=key)
    assert len(a) == len(b)
    assert a == b
