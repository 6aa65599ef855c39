"""Every query of the reference's operators against its SQL, over the smallest tables."""

import datetime
import math

import duckdb
import pytest

from rillgraph.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float) and math.isnan(x):
            return None
        return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x

    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
