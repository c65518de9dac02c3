"""Every registered query with a SQL twin against DuckDB on the smallest data set."""

import glob
import os

import numpy as np
import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def names():
    from fluvial.plans import registry

    return sorted(registry.ORACLE_SQL)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].astype("float64") if df[c].dtype.kind in "iufb" else df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, db, name):
    from fluvial.plans import registry

    got, want = plain(registry.QUERIES[name](spark, FOLDER).toPandas()), plain(db.sql(registry.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c], rtol=0, atol=1e-9, equal_nan=True), c
        else:
            assert (got[c] == want[c]).all(), c


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
