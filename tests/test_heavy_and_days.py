"""Most frequent keys by a summary against a full count; day states merged against the visits themselves."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagegauge.operators import heavy, logs, tenants


def _skewed(spark, n):
    """Key k of the first thirty has 40 * (30 - k) rows, all others have one."""
    often = spark.range(30).select(F.concat(F.lit("often "), "id").alias("url"), F.explode(F.sequence(F.lit(1), (30 - F.col("id")) * 40)).alias("x")).select("url")
    return often.unionByName(spark.range(n).select(F.concat(F.lit("rare "), "id").alias("url"))).repartition(7)


def _top(rows, top):
    return [tuple(r) for r in rows.groupBy("url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url").limit(top).collect()]


def test_summary_proves_the_top(spark):
    rows = _skewed(spark, 60_000)
    near = heavy.candidates(rows, "url", 10, tracked=2_000)
    assert near is not None and near.count() < 20_000
    assert [tuple(r) for r in tenants.most_scanned(rows, 10, 2_000).collect()] == _top(rows, 10)


@pytest.mark.parametrize("rows", ["even", "few", "none", "null"])
def test_what_a_summary_cannot_prove(spark, rows):
    df = {
        "even": spark.range(50_000).select(F.concat(F.lit("u"), F.col("id") % 25_000).alias("url")),
        "few": spark.createDataFrame([("a",), ("b",), ("a",)], "url string"), "none": spark.createDataFrame([], "url string"), "null": spark.createDataFrame([(None,), ("a",)], "url string"),
    }[rows]
    assert (heavy.candidates(df, "url", 10, tracked=500) is None) == (rows == "even")
    assert [tuple(r) for r in tenants.most_scanned(df.where("url is not null"), 10, 500).collect()] == _top(df.where("url is not null"), 10)


def test_visits_of_frequent_pages(spark):
    rows = _skewed(spark, 30_000).withColumns({"ts": F.lit(dt.datetime(2024, 1, 2)), "bot": F.concat(F.lit("bot"), F.pmod(F.xxhash64("url", F.rand(3)), F.lit(3)))}).cache()
    plain = lambda v: [tuple(r) for r in logs.top_pages(logs.visit_counts(v), 20).collect()]
    assert plain(logs.frequent_visits(rows, 20, 2_000)) == plain(rows)


def _visits(spark, n, days=10):
    at = F.timestamp_add("DAY", (F.col("id") % days).cast("int"), F.lit(dt.datetime(2024, 1, 1)))
    return spark.range(n).select(at.alias("ts"), F.concat(F.lit("bot"), F.col("id") % 3).alias("bot"), F.concat(F.lit("/p"), (F.col("id") * 7919) % (n // 2)).alias("url"))


def test_days_merge_exactly_below_their_entries(spark):
    visits = _visits(spark, 6_000)
    states = logs.day_states(visits)
    assert states.count() == 30
    got = {r["bot"]: tuple(r) for r in logs.merged_breakdown(states.where("day >= '2024-01-04'")).collect()}
    late = visits.where("ts >= '2024-01-04'")
    assert got == {r["bot"]: tuple(r) for r in logs.bot_breakdown(logs.visit_counts(late)).collect()}
    assert tuple(logs.merged_totals(states).first()) == tuple(logs.totals(logs.visit_counts(visits)).first())
    assert tuple(logs.merged_totals(states.where("false")).first()) == (0, 0)


def test_error_of_merged_days(spark):
    visits = _visits(spark, 400_000)
    exact = logs.totals(logs.visit_counts(visits)).first()
    got = logs.merged_totals(logs.day_states(visits)).first()
    assert got["total_visits"] == exact["total_visits"] and abs(got["unique_pages"] / exact["unique_pages"] - 1) < 4 * 0.0157
