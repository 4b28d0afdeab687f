from pathlib import Path

import duckdb
import pytest

import compare
from fieldlark.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in compare.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_equals_its_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    got = compare.rows(df.columns, df.collect())
    if name in queries.SQL:
        res = con.execute(queries.SQL[name])
        names = [c[0] for c in res.description]
        assert sorted(names) == sorted(df.columns) and got == compare.rows(names, res.fetchall())
    else:
        assert got
