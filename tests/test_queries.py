"""Every query with SQL against DuckDB, on whole tables."""

import math
from collections import Counter

import duckdb
import pytest

from loamwork.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in SQL:
        expected = duck.sql(SQL[name])
        names = [c if isinstance(c, str) else c[0] for c in expected.columns]
        assert sorted(names) == sorted(df.columns)
        numbers = [tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in expected.fetchall()]
        assert bag(df.columns, rows) == bag(names, numbers)
