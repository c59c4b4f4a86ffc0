"""Every core query against its SQL on the smallest data."""

import os

import duckdb
import pytest

from lumigraph.plans import queries as core

DATA = os.environ.get("LUMIGRAPH_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        if kind.startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif kind.startswith("float"):
            df[c] = df[c].round(6)
        df[c] = df[c].map(lambda v: "" if v is None or v != v else str(v)).astype(str).str.replace(r"\.0$", "", regex=True)
    return sorted(map(tuple, df.values.tolist()))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_same_as_sql(spark, con, name):
    got, want = core.QUERIES[name](spark, DATA).toPandas(), con.execute(core.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, DATA).count() > 0


def test_entry_counts_every_face(spark):
    from pyspark.sql import functions as F

    import __spark_entry__ as e

    assert e.entry(spark).agg(F.sum("n_faces")).first()[0] == spark.read.parquet(f"{DATA}/embeddings.parquet").count()
