"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import glob
import os

import pytest

from planquant.plans import registry

DATA = "/root/testdata/sf0.001"


def rows(frame, columns):
    import pandas as pd

    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, float) or "float" in type(x).__name__:
            return round(float(x), 6)
        if isinstance(x, bool) or "bool" in type(x).__name__:
            return bool(x)
        return float(x) if "int" in type(x).__name__ else str(x)

    return sorted(repr([plain(x) for x in r]) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as from '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got) > 0
        return
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
