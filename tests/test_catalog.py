"""Every query with SQL against DuckDB, at the smallest scale."""

from __future__ import annotations

from pathlib import Path

import pytest

from millrace.plans import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, str(DATA))
    cols = sorted(got.columns)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()
    rows = got.select(*[f"`{c}`" for c in cols]).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted([tuple(map(plain, r)) for r in rows], key=key) == sorted([tuple(map(plain, r)) for r in want], key=key)


def test_approximate_distinct_is_near(spark):
    exact = spark.read.parquet(str(DATA / "orders.parquet")).select("o_custkey").distinct().count()
    got = catalog.queries()["approximate_distinct"](spark, str(DATA)).first()[0]
    assert abs(got - exact) <= 0.1 * exact
