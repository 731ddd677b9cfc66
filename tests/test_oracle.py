"""Every query against its SQL twin on the smallest tables, and the driver's contract."""

import math
import os

import duckdb
import pytest

from lexiform.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(round(float(value), 9)) if isinstance(value, (int, float)) and not isinstance(value, bool) else repr(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    left = sorted(tuple(plain(v) for v in r) for r in got.select(*cols).collect())
    right = sorted(tuple(plain(v) for v in r) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert left == right


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    import __spark_entry__

    assert set(SQL) <= set(QUERIES) <= set(__spark_entry__.queries())
    if os.path.isdir(SF):
        df = __spark_entry__.entry(spark)
        assert df.columns == ["form_id", "fact_id", "rank"] and df.count() > 0
