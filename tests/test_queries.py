"""Every query with SQL gives the same rows as DuckDB; the others give rows."""

import os

import duckdb
import pytest

from wayline import registry

from conftest import SMALL

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SMALL}/{t}'")
    return c


def plain(x):
    if x is None or x != x:
        return ""
    if isinstance(x, float):
        x = round(x, 5) + 0.0
    s = str(x)
    return s[:-2] if s.endswith(".0") else s


def rows(frame, columns):
    return sorted(tuple(plain(x) for x in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows(got, columns) == rows(want, columns)
    else:
        assert len(got.columns)
