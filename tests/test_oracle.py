"""Every plan with SQL gives DuckDB's rows; the others give some."""

import math

import duckdb
import pytest

from pagewright.plans.catalog import FLAGSHIP, ORACLE_SQL, QUERIES

TABLES = "customer events documents embeddings pages benchmark labels conversations orders lineitem".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def sorted_rows(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, data, duck, name):
    found = QUERIES[name](spark, data)
    rows = found.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    result = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted_rows(rows, found.columns) == sorted_rows(result.fetchall(), columns)
