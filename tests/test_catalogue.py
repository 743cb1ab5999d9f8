"""Every query against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillgraph.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = duck.sql(SQL[name])
    assert columns == sorted(want.columns)
    want = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({SQL[name]}) AS q")
    assert [KINDS[dict(df.dtypes)[c]] for c in columns] == [str(t) for t in want.types]
    assert rounded(df.select(*columns).collect()) == rounded(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_edges_are_read_by_relation(spark, sf_dir):
    """Only the tables and columns of the relations asked for are scanned."""
    plan = QUERIES["path_nation_region"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "lineitem" not in plan and "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in plan
