"""Every query with SQL gives the rows that DuckDB gives."""

import decimal

import duckdb
import pytest

from cutloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(([plain(x) for x in r] for r in df.select(*columns).collect()), key=repr)
    names = ", ".join(f'"{c}"' for c in columns)
    want = sorted(([plain(x) for x in r] for r in duck.sql(f"SELECT {names} FROM ({plans.ORACLE_SQL[name]})").fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0
