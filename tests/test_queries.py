"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from corvane.plans import registry  # noqa: E402


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    c.execute("SET disabled_optimizers = 'statistics_propagation'")  # it takes isnan for false where a file's statistics hide NaN
    for p in Path(tables).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, tables, duck, name):
    df = registry.queries()[name](spark, tables)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert got == sorted(tuple(norm(r[i]) for i in order) for r in want.fetchall())
