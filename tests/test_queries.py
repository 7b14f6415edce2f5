"""Registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from pagegauge.plans import ORACLE, QUERIES
from pagegauge.sources.bridge import TABLES


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return list(map(_plain, v)) if isinstance(v, list | tuple) else v


def _rows(names, rows):
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted((repr([_plain(r[i]) for i in at]) for r in rows))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name in ORACLE:
        result = duck.execute(ORACLE[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert _rows(df.columns, rows) == _rows(names, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
