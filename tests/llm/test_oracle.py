import duckdb
import pytest

from ridgework.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = queries.queries()[name](spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(found.fetchall(), key=key)
