"""Every registered query against its SQL in another engine, and the shape of the plans."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from cladespark.plans import oracle, registry

SF_DIR = "/root/testdata/sf0.001"
SIZES = ("sf0.001", "sf0.01")
QUERIES, SQL = registry.QUERIES, oracle.SQL


@pytest.fixture(scope="module", params=SIZES)
def tables(request):
    """A folder of tables and the same tables in the other engine."""
    connection = duckdb.connect()
    folder = f"/root/testdata/{request.param}"
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return folder, connection


def plain(rows):
    def value(v):
        return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    folder, other = tables
    found = QUERIES[name](spark, folder)
    expected = other.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(columns)
    rows = found.select(*[f"`{c}`" for c in columns]).collect()
    assert rows and plain(rows) == plain(expected.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_")])
def test_plan(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "PythonUDF", "InPandas"):
        assert operator not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["uncovered_intervals"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and not any("l_extendedprice" in line or "l_shipdate" in line for line in scans)
    reads = spark.read.parquet(f"{SF_DIR}/events.parquet")
    from cladespark.operators.catalog import lookup

    assert "EqualTo(event_type,click)" in lookup(reads, "event_type", "click")._jdf.queryExecution().toString()


def test_flagship(spark):
    calls = entry_points.entry(spark)
    assert calls.columns == ["sample_id", "id", "call"] and calls.count() == 30
