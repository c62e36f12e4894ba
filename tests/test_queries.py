"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from hushframe.plans import queries as Q

DATA = "/root/testdata/sf0.001"


def plain(x):
    if x is None or x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, con, name):
    got, want = Q.QUERIES[name](spark, DATA).toPandas(), con.execute(Q.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(tuple(map(repr, map(plain, r))) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False)) for df in (got, want)]
    assert rows[0] == rows[1]
