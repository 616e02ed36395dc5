"""Every query with SQL against DuckDB on the smallest data; the others for rows and schema."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.plans import catalog, curation, details, identity, voices  # noqa: F401

DATA = "/root/testdata/sf0.001"


def cell(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = df.collect()
    columns = sorted(df.columns)
    if name not in catalog.ORACLE:
        assert rows
        return
    found = duck.sql(catalog.ORACLE[name])
    at = [found.columns.index(c) for c in columns]
    expected = sorted((tuple(cell(r[i]) for i in at) for r in found.fetchall()), key=str)
    assert sorted((tuple(cell(r[c]) for c in columns) for r in rows), key=str) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


# shares a step, the rounded score: all queries on scored tokens
@pytest.mark.parametrize("name", ["nucleus", "top_k_with_ties", "top_k_exact", "repetition_penalty", "guidance", "dual_guidance"])
def test_scores_are_rounded_as_in_sql(spark, tmp_path, name):
    con = duckdb.connect()
    prices = [68500.0, 68000.0, 63500.0, 64000.0, 94500.0, 94000.0, 99500.0, 104500.0, 30500.0, 30449.99, 25500.0, 34500.0]
    values = ", ".join(f"({i // 3}, {i % 3 + 1}, {i % 5}, {p}, 0.05, 0.02)" for i, p in enumerate(prices))
    con.execute(f"CREATE TABLE lineitem AS SELECT k::BIGINT AS l_orderkey, n::INT AS l_linenumber, s::BIGINT AS l_suppkey, p::DOUBLE AS l_extendedprice, d::DOUBLE AS l_discount, t::DOUBLE AS l_tax FROM (VALUES {values}) v(k, n, s, p, d, t)")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    found = con.sql(catalog.ORACLE[name])
    at = [found.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in found.fetchall())
