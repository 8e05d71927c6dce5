"""Every query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pandas
import pytest

from veilscope.plans import queries

DIR = "/root/testdata/sf0.001"


def cell(x):
    if x is None or isinstance(x, (str, bool)):
        return x
    return None if pandas.isna(x) else float(x)


def rows(frame, names):
    return sorted(str([cell(x) for x in r]) for r in frame[names].astype(object).values.tolist())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, DIR).toPandas()
    if name not in queries.SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as from '{DIR}/{t}.parquet'")
    want = con.sql(queries.SQL[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names and rows(got, names) == rows(want, names)
