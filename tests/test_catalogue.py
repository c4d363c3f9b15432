"""Every query with SQL against DuckDB, every other one for rows, on the tables of the correctness gate."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewatch.plans import catalogue

SF = "/root/testdata/sf0.01"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, int | float | np.number) and not isinstance(v, bool | np.bool_):
        return round(float(v), 6) + 0.0
    return str(pd.Timestamp(v))[:19] if hasattr(v, "year") else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalogue.ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["horn_slope", "fast_marching"])
def test_every_raster_is_read(spark, name):
    rasters = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").distinct().count()
    assert catalogue.QUERIES[name](spark, SF).select("raster_id").distinct().count() == rasters


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
