"""Every query of the engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from folioloom.plans import load

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REGISTRY = load()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows(found, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(spark, duck, name):
    df = REGISTRY.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in REGISTRY.SQL:
        assert got
        return
    want = duck.sql(REGISTRY.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(got, df.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 1


def test_at_least_two_classes(spark):
    assert REGISTRY.QUERIES["documents_by_category"](spark, SF).count() >= 4
