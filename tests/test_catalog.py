"""Every query with SQL gives what DuckDB gives, on the smallest tables; the others give rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from quillmark.plans.catalog import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if type(value).__name__ == "Decimal":
        return float(value)
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = [sorted((k, repr(plain(v))) for k, v in r.asDict().items()) for r in got.collect()]
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    columns = want.columns
    assert sorted(got.columns) == sorted(columns)
    assert sorted(rows) == sorted(sorted((k, repr(plain(v))) for k, v in zip(columns, r)) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
