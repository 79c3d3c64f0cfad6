"""Queries of the training operators that have SQL give DuckDB's rows; the others run."""

from pathlib import Path

import duckdb
import pytest

from corvane.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_matches_sql(spark, tables, name):
    duck = duckdb.connect()
    duck.execute("SET disabled_optimizers = 'statistics_propagation'")
    for p in Path(tables).glob("*.parquet"):
        duck.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, tables)
    want = duck.sql(sql.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in df.collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("name", ["p2_pairs", "p6_pairs", "p6_groups", "p8_found", "p9_levels"])
def test_query_runs_on_whole_tables(spark, tables, name):
    assert queries.QUERIES[name](spark, tables).count() > 0
