"""Every query with an equivalent is held against DuckDB."""

import os
from collections import Counter

import duckdb
import pytest

from airrline.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA)
    result = db.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(result.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(ORACLE) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
