"""Every registered query against its oracle at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from cadenza.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("nation", "customer", "lineitem", "orders", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("null" if pd.isna(v) else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_oracle(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(registry.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert {*registry.QUERIES} <= {*__spark_entry__.queries()}
    assert {*__spark_entry__.oracle_sql()} <= {*__spark_entry__.queries()}
