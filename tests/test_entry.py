"""Queries of the catalogue against their SQL on small tables, as the driver compares them."""

import math

import duckdb
import pytest

from marginalia.plans import catalog, corpus, reports

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = catalog.ORACLE_SQL | corpus.ORACLE_SQL | reports.ORACLE_SQL
QUERIES = catalog.QUERIES | corpus.QUERIES | reports.QUERIES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.8g}")
    return int(v) if isinstance(v, (int, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    frame = QUERIES[name](spark, DIR)
    names = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in frame.collect()), key=repr)
    answer = duck.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True))) for r in answer.fetchall()), key=repr)
    assert got == want


def test_rows_only_queries_run(spark):
    for name in QUERIES.keys() - ORACLES.keys():
        assert QUERIES[name](spark, DIR).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
