"""Every registered query that has an oracle gives its rows on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from voltspan.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return db


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not there")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=repr)
    found = duck.execute(ORACLES[name])
    there = [c[0] for c in found.description]
    assert sorted(there) == columns
    want = sorted((tuple(plain(r[there.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def test_queries_without_oracle_run(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
