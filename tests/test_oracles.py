"""Every query that has oracle SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from chronolane import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    return float(f"{v:.9g}") if isinstance(v, float) else v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([_plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, sf_dir, name):
    df = plans.queries()[name](spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(plans.oracle_sql()[name])
    want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_rows_only_queries_run(spark, sf_dir):
    for name in sorted(set(plans.queries()) - set(plans.oracle_sql())):
        assert plans.queries()[name](spark, sf_dir).columns
