"""Every registered query against DuckDB, or its shape where there is no SQL."""

import math
import os

import duckdb
import pytest

from tesserapy.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    fix = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(fix(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    got = df.collect()
    assert got
    sql = registry.oracle_sql().get(name)
    if sql:
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(columns, want.fetchall())
