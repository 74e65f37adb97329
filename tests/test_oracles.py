"""Every query with SQL gives the same rows as DuckDB over the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from veilcount.plans.queries import QUERIES
from veilcount.plans.sql import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(found, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    found = df.collect()
    assert found, "a query that compares nothing"
    assert rows(found, df.columns) == rows(got.fetchall(), columns)


def test_requests_are_answered_or_told_why(spark):
    told = [r for r in QUERIES["benchmark_request"](spark, SF).collect()]
    assert {r["direction"] for r in told if r["available"]} >= {"ahead", "behind"}
    assert {r["reason"] for r in told if not r["available"]} >= {"workspace_not_profiled", "too_few_contributors"}
    assert {r["direction"] for r in QUERIES["benchmark_compare"](spark, SF).collect()} >= {"ahead", "behind"}


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == QUERIES["gate_suppressions"](spark, SF).count() + QUERIES["gate_releases"](spark, SF).count() > 0
