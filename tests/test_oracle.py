"""Every core query against its reference SQL in DuckDB, over whole tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from orrery.plans import catalog


#: Queries whose result SQL cannot express; they are tested elsewhere.
NO_SQL: set[str] = set()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, list):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    assert name in catalog.SQL or name in NO_SQL
    if name in NO_SQL:
        return
    cur = duck.execute(catalog.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(norm(r[i]) for i in at)) for r in cur.fetchall())
