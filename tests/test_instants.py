"""Instants less than a second apart are still before and after each other."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pagegauge.functions import exprs
from pagegauge.operators import json_ld, pages
from pagegauge.plans import QUERIES

_AS_OF = dt.datetime(2024, 1, 31)
_TICK = dt.timedelta(microseconds=1)
_GIVEN = [(_AS_OF - _TICK, True), (_AS_OF, False), (_AS_OF + _TICK, False), (_AS_OF - dt.timedelta(days=10), False), (_AS_OF - dt.timedelta(days=10) + _TICK, True)]


def test_recent_to_the_microsecond(spark):
    rows = spark.createDataFrame([(at, want) for at, want in [*_GIVEN, (None, False)]], "at timestamp_ntz, want boolean")
    got = rows.select("want", exprs.is_recent(F.col("at"), F.lit(_AS_OF).cast("timestamp_ntz"), 10).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_freshness_of_events(spark, tmp_path):
    events = [(k, at, want) for k, (at, want) in enumerate([*_GIVEN, (None, None)])]
    spark.createDataFrame([e[:2] for e in events], "event_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    assert {r["event_id"]: r["recent"] for r in QUERIES["p30_freshness"](spark, str(tmp_path)).collect()} == {k: want for k, _, want in events}


def test_fresh_page_of_the_last_second(spark):
    html = '<html><body><time datetime="2024-01-30 23:59:59.5">now</time></body></html>'
    page = json_ld.with_json_ld(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert pages.dates_and_author(page, F.lit(_AS_OF)).first()["fresh"]
