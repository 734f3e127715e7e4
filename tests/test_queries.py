"""Every query that has a SQL twin gives the same rows over the smallest tables."""

import math
import os

import duckdb
import pytest

from sqltraffic.plans.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def _text(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "None"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(_text(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name in oracle_sql():
        found = con.execute(oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == sorted(tuple(_text(r[i]) for i in order) for r in found.fetchall())
    else:
        assert got
