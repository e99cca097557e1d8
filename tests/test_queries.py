"""Every registered query against its SQL on the given tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_sql(spark, tables, name):
    result = entry.queries()[name](spark, SF)
    got = result.toPandas()
    if name not in entry.oracle_sql():
        assert len(got) > 0
        return
    relation = tables.sql(entry.oracle_sql()[name])
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: TYPES[t] for c, t in result.dtypes} == types
    wanted = relation.df()
    wanted = wanted.astype({c: "float64" for c in wanted if str(wanted[c].dtype).startswith("Int")})
    columns = sorted(got.columns)
    assert len(got) == len(wanted) and len(got) > 0
    a, b = (f[columns].sort_values(columns).reset_index(drop=True) for f in (got, wanted))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, check_exact=True)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["c", "r", "z"]
