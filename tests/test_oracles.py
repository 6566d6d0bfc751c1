"""Every registered query against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from roomtide.catalog.queries import TABLES

FOLDER = Path("/root/testdata/sf0.001")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
              "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.6f}"
    return value


def ordered(rows):
    return sorted((tuple(map(plain, row)) for row in rows), key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, str(FOLDER))
    relation = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    types = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: DUCK_TYPES[t] for c, t in df.dtypes} == types
    ours = ordered([row[c] for c in columns] for row in df.collect())
    theirs = ordered([row[relation.columns.index(c)] for c in columns] for row in relation.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_fitted_models_return_rows(spark, name):
    assert QUERIES[name](spark, str(FOLDER)).count() > 0


def test_flagship(spark):
    assert entry_module.entry(spark).count() == 5
