"""Every query with SQL gives the rows that the SQL gives."""

import datetime
import glob
import os

import pytest

import __spark_entry__
from chunkloom.plans import registry

SF = "/root/testdata/sf0.001"


def normal(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert not any(isinstance(v, datetime.datetime) for r in got for v in r)
    if name not in registry.ORACLE_SQL:
        assert got
        return
    wanted = duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert got == sorted((tuple(map(normal, r)) for r in wanted), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
