"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from docloom.functions.dialect import TABLES
from docloom.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return ""
    if isinstance(value, float):
        return f"{value:.9g}" if not math.isinf(value) else str(value)
    return f"{float(value):.9g}" if hasattr(value, "__float__") and not isinstance(value, (str, bool)) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    assert got.count() > 0 and len(set(got.columns)) == len(got.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
