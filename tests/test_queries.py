"""Every registered query with a SQL twin against DuckDB, on the smallest tables."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
# The training-text queries have tests of their own, which go with their package.
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (int, float)):
        return repr(float(value))
    if isinstance(value, dt.datetime):
        return value.isoformat(timespec="microseconds")
    return str(value)


def test_every_oracle_has_a_query():
    assert ORACLES.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith("op")))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    expected = relation.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    got = df.select(*[f"`{c}`" for c in columns]).collect()
    assert sorted([plain(v) for v in row] for row in got) == sorted([plain(v) for v in row] for row in expected)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() == 935 and df.where("avg_duration_prev_7days IS NOT NULL").count() > 600


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLES) if not n.startswith("op") and n != "pipeline"))
def test_query_without_sql_returns_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_no_python_in_the_data_path(spark):
    for name in ("training_table", "trim_p95", "describe_numeric", "group_scores", "request_validation", "weather_gaps"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "MapInPandas" not in plan, name
