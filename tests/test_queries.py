"""Every registered query against its DuckDB SQL on the smallest tables; the others at least run."""

import glob
import os

import duckdb
import pytest

from loamwork.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = [os.path.basename(p).removesuffix(".parquet") for p in glob.glob(f"{SF}/*.parquet")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


@pytest.mark.skipif(not TABLES, reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in registry.oracle_sql():
        assert rows
        return
    got = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert rows == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in got.fetchall())


def test_entry(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.columns == ["split", "lang", "bucket", "n_docs", "n_tokens"] and got.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
