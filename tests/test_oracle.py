"""Every registered query against its SQL on the smallest data set."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    mine = queries()[name](spark, SF).toPandas()
    if name in oracle_sql():
        assert difference(mine, duck.execute(oracle_sql()[name]).df()) is None
    else:
        assert len(mine) > 0


def test_flagship(spark):
    assert entry(spark).columns[:2] == ["question_id", "rank"]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
