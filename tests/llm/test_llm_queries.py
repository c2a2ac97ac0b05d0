"""The operators' queries against their SQL."""

import pytest
from conftest import DATA
from oracle import compare, connect

from tidemark.llm import queries


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, DATA, queries.QUERIES[name], queries.ORACLE_SQL[name]) > 0


def test_native_operators_run_no_python(spark):
    for name in ("op1_url_filter", "op2_decontaminate", "op10_perspectives"):
        plan = queries.QUERIES[name](spark, str(DATA))._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name
