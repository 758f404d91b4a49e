"""Every query with a SQL twin gives the twin's rows."""

import math

import duckdb
import pytest
from promptloom.plans import catalog

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool):
        return str(int(v))
    if v is None or isinstance(v, str):
        return str(v)
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.6g}" if not isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, sql, name):
    df = catalog.queries()[name](spark, SMALL)
    rel = sql.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    assert sorted([plain(v) for v in r] for r in df.collect()) == sorted([plain(r[i]) for i in order] for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    df = catalog.queries()[name](spark, SMALL)
    assert df.columns and df.count() >= 0


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
