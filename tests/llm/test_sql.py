from pathlib import Path

import duckdb
import pytest

import compare
from fieldlark.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    res = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(df.columns) and compare.rows(df.columns, df.collect()) == compare.rows(names, res.fetchall())


def test_every_operator_has_one_query():
    assert [f"op{n}_" for n in range(1, 14)] == sorted((f"{q.split('_')[0]}_" for q in queries.queries()), key=lambda x: int(x[2:-1]))
