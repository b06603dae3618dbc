"""Every core query with SQL gives, row by row, what DuckDB gives."""

from __future__ import annotations

import duckdb
import pytest

from wayspark.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = duck.sql(core.ORACLE_SQL[name])
    names = res.columns
    assert cols == sorted(names)
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in res.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(core.ORACLE_SQL) <= set(core.QUERIES)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(core.QUERIES) <= set(e.queries())
