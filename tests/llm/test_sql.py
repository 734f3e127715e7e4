"""Every query of this subpackage that has a SQL twin gives the same rows over the smallest tables."""

import os

import duckdb
import pytest

from sqltraffic.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    found = con.execute(oracle_sql()[name])
    columns = [d[0] for d in found.description]
    text = lambda r: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(text, queries()[name](spark, SF).select(*columns).collect())) == sorted(map(text, found.fetchall()))
