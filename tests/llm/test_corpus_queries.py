"""The registered corpus queries: against their SQL where there is one, and the whole tables read."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from cladespark.llm import registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    connection = duckdb.connect()
    for p in sorted(Path(SF_DIR).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


def plain(rows):
    return sorted((tuple(float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in r) for r in rows), key=repr)


def test_all_operators_and_the_pipeline_are_registered():
    names = [n for n in entry_points.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry_points.queries()
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram join", "mixing", "packing"]


@pytest.mark.parametrize("name", registry.SQL)
def test_query_and_sql(spark, other, name):
    found = registry.QUERIES[name](spark, SF_DIR)
    expected = other.execute(registry.SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(columns)
    assert plain(found.select(*columns).collect()) == plain(expected.fetchall())
