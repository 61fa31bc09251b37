"""Every registered query with SQL is held against DuckDB on the smallest driver tables."""

import os

import duckdb
import pytest

from touchline import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def bag(rows):
    return sorted((tuple(repr(x) for x in r) for r in rows))


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert bag(got.select(*cols).collect()) == bag(duck.sql(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]})").fetchall())
