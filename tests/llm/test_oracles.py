"""Queries of the operators that SQL can express, against DuckDB."""

import duckdb

from chronolane.llm import registry


def test_queries_equal_their_oracles(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "pages", "labels", "benchmark", "embeddings", "conversations"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, sf_dir)
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert sorted(map(repr, ((*r,) for r in df.select(*columns).collect()))) == sorted(map(repr, want.fetchall())), name
