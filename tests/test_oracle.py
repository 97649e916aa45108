"""Every registered query on the reference's operators against its SQL in DuckDB."""

import os

import pytest

import __spark_entry__ as registered
from workloads import checks
from tests.compare import duck, duck_result, duck_types, spark_result

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# Python in tasks, and joins that compare every row with every other.
FORBIDDEN = (
    "EvalPython",
    "InPandas",
    "InArrow",
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
)


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_query(spark, connection, name):
    df = registered.queries()[name](spark, SF_DIR)
    sql = registered.oracle_sql().get(name)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in FORBIDDEN:
        assert node not in plan, node
    columns, rows = spark_result(df)
    if sql is None:
        assert rows
        return
    wanted_columns, wanted = duck_result(connection, sql)
    assert columns == wanted_columns
    assert dict(df.dtypes) == duck_types(connection, sql)
    assert len(rows) == len(wanted)
    assert rows == wanted


def test_entry(spark):
    assert registered.entry(spark).count() == 11
