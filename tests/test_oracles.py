"""Every registered query with a SQL counterpart gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def table(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(plain(v) for v in row) for row in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query(spark, sf, duck, name):
    got = table(driver.queries()[name](spark, sf).toPandas())
    want = table(duck.execute(driver.oracle_sql()[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-6) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(n for n in driver.queries() if n not in driver.oracle_sql() and not n.startswith("op") and n != "pipeline"))
def test_query_without_sql_has_rows(spark, sf, name):
    assert driver.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    got = driver.entry(spark)
    assert got.columns == ["id", "score"] and got.count() == 10
