"""Every registered library query against its SQL in DuckDB."""

import duckdb
import pytest

from larkspur.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, con, name):
    got = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    assert rows == sorted(map(repr, want.select(*columns).fetchall()))


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "score"] and df.count() == 10
    assert set(catalogue.oracle_sql()) <= set(__spark_entry__.queries())
