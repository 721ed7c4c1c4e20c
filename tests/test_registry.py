"""Every registered retrieval query against its SQL in DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from sparklode.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SF}/{f}'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    sql = registry.ORACLE_SQL.get(name)
    assert len(found)
    if sql:
        assert rows(found) == rows(duck.sql(sql).df())
