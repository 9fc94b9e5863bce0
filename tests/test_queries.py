"""Every registered query against its SQL twin, and the shape of its plan."""

import duckdb
import pytest

from __spark_entry__ import FOLDER, entry
from __spark_entry__ import oracle_sql as every_sql
from __spark_entry__ import queries as every_query
from askgrid.workload import all_queries as queries
from askgrid.workload import all_sql
from check import TABLES, rows_of

SQL = all_sql()
# Expressible only through Spark's own hash, a trained index, or many pages of SQL; these have
# brute-force or equality tests elsewhere.
WITHOUT_SQL = {"a12_a13_a14_chunk_documents"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{FOLDER}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got, columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert name in WITHOUT_SQL and got
        return
    result = duck.execute(SQL[name])
    want, wanted_columns = rows_of([c[0] for c in result.description], result.fetchall())
    assert columns == wanted_columns
    assert got == want


def test_every_sql_has_a_query_and_the_entry_runs(spark):
    assert set(every_sql()) <= set(every_query())
    assert set(queries()) <= set(every_query())
    assert set(queries()) - set(SQL) == WITHOUT_SQL
    assert entry(spark).limit(1).count() == 1
