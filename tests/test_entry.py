import duckdb
import pytest

import __spark_entry__
from silterra.plans import catalogue

TABLES = ("documents", "conversations", "benchmark", "embeddings", "pages", "labels")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(frame):
    """Sorted rows with their columns in order of names."""
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda v: None if v is None or v != v else v.item() if hasattr(v, "item") else v
    return sorted(([plain(v) for v in r] for r in frame.values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    got = __spark_entry__.queries()[name](spark, sf).toPandas()
    want = duck.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql_but_those_that_sql_cannot_express():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"tokenize_bpe"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
