"""Every named query against its SQL in DuckDB, and the shape of the plans."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

QUERIES, SQL = entry_module.CATALOG, entry_module.ORACLE


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(value) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in ("pages", "events", "orders"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def frame_of(spark, sf_dir):
    """Builds each query once; many of them materialise tables on the way."""
    built = {}

    def build(name):
        if name not in built:
            built[name] = QUERIES[name](spark, sf_dir)
        return built[name]

    return build


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(frame_of, duck, name):
    frame = frame_of(name)
    columns = sorted(frame.columns)
    ours = sorted(tuple(cell(r[c]) for c in columns) for r in frame.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    theirs = sorted(tuple(cell(r[i]) for i in places) for r in result.fetchall())
    assert ours == theirs and ours


PYTHON_ALLOWED = {"capture_plan", "planned_vs_deferred", "pacing"}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_plans_stay_in_the_jvm(frame_of, name):
    plan = frame_of(name)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "html#" not in plan
    if name not in PYTHON_ALLOWED:
        assert "Python" not in plan and "InPandas" not in plan


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_module.queries()) and set(SQL) <= set(entry_module.oracle_sql())


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["run_id", "source", "norm_url", "reason"]
