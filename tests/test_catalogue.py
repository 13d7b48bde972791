"""Every relational query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from codelake import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(rows):
    return sorted(repr([round(x, 6) if isinstance(x, float) else list(x) if isinstance(x, (list, tuple)) else x for x in row]) for row in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    found = catalogue.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in found.columns)
    assert plain(found.collect()) == plain(db.execute(f"SELECT {columns} FROM ({catalogue.ORACLE_SQL[name]})").fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
