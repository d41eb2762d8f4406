"""Every query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from keyloom.plans import code, configs, imports, normalising, portal, registry, rollups, streaming  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df):
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(map(repr, ([plain(v) for v in r] for r in df[sorted(df.columns)].astype(object).values.tolist())))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, db, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(registry.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0
