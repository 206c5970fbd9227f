"""Every query with SQL against DuckDB over the same tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from offerlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float | Decimal):
        return None if math.isnan(value) else float(value)
    return value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    run, sql = catalog.QUERIES[name]
    got = run(spark, SF)
    rows = [tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()]
    assert sql, "a query without SQL needs a brute-force test of its own"
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    expected = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()]
    assert sorted(got.columns) == sorted(names)
    assert sorted(rows, key=repr) == sorted(expected, key=repr)
