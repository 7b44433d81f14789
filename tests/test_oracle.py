"""Every registered query against its DuckDB oracle on the smallest driver tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from disputelens.plans.catalog import ORACLE_SQL, QUERIES
from tools.compare import SPARK_TO_DUCK, TABLES, canon

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    assert set(ORACLE_SQL) == set(QUERIES)
    assert set(QUERIES) <= set(queries()) and set(ORACLE_SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = queries()[name](spark, SF_SMALL)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    otypes = {d[0]: str(d[1]) for d in res.description}
    want = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes} == otypes
    assert canon(got, df.columns) == canon(want, ocols)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["category", "n_invoices"]
    assert df.count() > 0
