"""Every registered query of the core engine against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from veilgraph.plans import function_queries as function_queries, registry

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def database():
    base = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        base.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return base


def normal(value):
    return int(value) if isinstance(value, float) and value == int(value) else value


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, database, name):
    df = registry.QUERIES[name](spark, str(TABLES))
    columns = sorted(df.columns)
    own = sorted((repr(tuple(normal(r[c]) for c in columns)) for r in df.collect()))
    sql = database.execute(registry.ORACLES[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(normal(dict(zip(names, row))[c]) for c in columns)) for row in sql.fetchall())
    assert own == theirs


def test_flagship(spark):
    assert registry.flagship(spark, str(TABLES)).count() > 0
