"""Queries that SQL can state, against DuckDB."""

import duckdb
import pytest

from rasterloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_matches_sql(name, spark):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = queries.queries()[name](spark, SF)
    cols = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(map(str, r)) for r in found.select(*cols).collect()) == sorted(tuple(map(str, r)) for r in want)


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in queries.queries() if n.startswith("op")] == [f"op{k}" for k in range(1, 11)]


def test_native_operators_run_no_python(spark):
    import re

    for name in ("op2_line_dedup", "op3_licenses", "op4_mixing", "op7_quality"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan), name
