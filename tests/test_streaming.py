"""Streaming jobs give what their batch forms give, over several bounded micro-batches."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pagegauge.operators import alerts, logs, tenants
from pagegauge.sources.bridge import view
from pagegauge.streaming import jobs

from .test_exprs_and_scoring import CREDITS, DELIVERIES


@pytest.fixture
def run(spark, tmp_path):
    def go(rows, order, job, parts=3, mode="append"):
        ranked = rows.orderBy(order).collect()
        step = -(-len(ranked) // parts)
        for k in range(parts):
            if chunk := ranked[k * step : (k + 1) * step]:
                spark.createDataFrame(chunk, rows.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        with jobs.rocks(spark):
            query = job(source).writeStream.outputMode(mode).format("memory").queryName("streamed").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(180), "the stream did not end in time"
        finally:
            query.stop()
        return spark.table("streamed")

    return go


@pytest.fixture
def fed(spark, tmp_path):
    """Runs a job over rows that are given batch by batch; the output, and what each batch did to the state."""

    def go(batches, schema, job):
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        with jobs.rocks(spark):
            query = job(source).writeStream.outputMode("append").format("memory").queryName("fed").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        try:
            assert query.awaitTermination(180), "the stream did not end in time"
            return spark.table("fed").collect(), [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        finally:
            query.stop()

    return go


def _at(rows, schema, spark):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(key, base + dt.timedelta(seconds=seq), seq, *rest) for key, seq, *rest in rows], schema)


def test_alert_stream(spark, sf_dir, run):
    scans = view(spark, sf_dir, "scans")
    expected = sorted(map(tuple, alerts.score_alerts(scans).select("id", "type", "title").collect()))
    got = run(scans, ["created_at", "id"], jobs.alert_stream)
    assert sorted(map(tuple, got.select("id", "type", "title").collect())) == expected and expected


def test_credit_stream(spark, run):
    events = _at(CREDITS, "org_id long, ts timestamp_ntz, seq long, kind string, amount int", spark)
    out = jobs.last_of_each(run(events, ["ts", "seq"], jobs.credit_stream), "org_id")
    assert {(r["org_id"], r["monthly"], r["remaining"]) for r in out.collect()} == {tuple(r) for r in tenants.credit_balances(events).collect()}


def test_breaker_stream(spark, run):
    sent = _at(DELIVERIES, "webhook_id long, ts timestamp_ntz, seq long, ok boolean", spark)
    out = jobs.last_of_each(run(sent, ["ts", "seq"], jobs.breaker_stream), "webhook_id")
    assert {(r["webhook_id"], r["failure_count"], r["active"]) for r in out.collect()} == {tuple(r) for r in tenants.breaker_states(sent).collect()}


def test_changed_pages(spark, run):
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "b"), (1, 5, "a"), (2, 6, None), (2, 7, None)]
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(p, "u", h, base + dt.timedelta(seconds=s), s) for p, s, h in rows], "project_id long, url string, content_hash string, ts timestamp_ntz, seq long")
    assert sorted(r["seq"] for r in run(df, ["seq"], jobs.changed_page_stream).collect()) == [1, 3, 5, 6, 7]


def test_visits_per_day(spark, sf_dir, run):
    lines = view(spark, sf_dir, "log_lines")
    as_of = F.expr("TIMESTAMP '2024-01-31 00:00:00'")
    expected = logs.visits(lines, as_of).groupBy(F.to_date("ts").alias("day"), "bot").count()
    got = run(lines, ["event_id"], lambda s: jobs.visits_per_day(s, as_of, "3 days"), mode="update")
    last = got.groupBy("day", "bot").agg(F.max("visits").alias("visits"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, expected.collect()))


HASHES = "project_id long, url string, content_hash string, ts timestamp_ntz, seq long"


def _day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_late_pages_are_dropped_and_old_state_is_forgotten(fed):
    batches = [
        [(1, "a", "x", _day(0), 1), (1, "b", "x", _day(0), 2)],
        [(1, "a", "x", _day(2), 3)],  # unchanged
        [(1, "c", "x", _day(40), 4)],  # the watermark goes to day 33
        [(1, "c", "x", _day(41), 5)],  # what b holds is forgotten
        [(1, "b", "y", _day(20), 6), (1, "c", "x", _day(41), 7)],  # the first is late; what a holds is forgotten
        [(1, "a", "x", _day(42), 8), (1, "c", "x", _day(42), 9)],  # so a is new again
    ]
    rows, states = fed(batches, HASHES, lambda s: jobs.changed_page_stream(s, "7 days", dt.timedelta(days=30)))
    assert sorted(r["seq"] for r in rows) == [1, 2, 4, 8]
    assert sum(s["numRowsDroppedByWatermark"] for s in states) == 1
    assert {s["customMetrics"]["rocksdbPutLatency"] >= 0 for s in states} == {True}


def test_state_is_kept_while_a_page_is_seen(fed):
    batches = [[(1, "a", "x", _day(20 * k), k)] for k in range(6)]
    rows, _ = fed(batches, HASHES, lambda s: jobs.changed_page_stream(s, "1 day", dt.timedelta(days=30)))
    assert [r["seq"] for r in rows] == [0]


def test_null_scores_do_not_end_the_stream(spark, sf_dir, fed):
    scans = view(spark, sf_dir, "scans").limit(1)
    row = scans.first().asDict()
    names = scans.columns
    with_ = lambda n, **x: tuple((row | {"id": n, "created_at": _day(n)} | x)[c] for c in names)
    batches = [[with_(1, score=90, schema=None)], [with_(2, score=None, schema=80)], [with_(3, score=40, schema=None), with_(4, score=None)], [with_(5, score=90)]]
    schema = StructType([StructField(f.name, f.dataType) for f in scans.schema])
    rows, _ = fed(batches, schema, jobs.with_previous_scores)
    got = {r["id"]: (r["score"], r["has_previous"], r["prev_score"], r["prev_schema"]) for r in rows}
    assert got == {1: (90, False, None, None), 2: (None, True, 90, None), 3: (40, True, None, 80), 4: (None, True, 40, None), 5: (90, True, None, row["schema"])}


def test_arriving_in_parts_is_the_whole_table(spark, sf_dir):
    from pagegauge.sources.bridge import arriving_in_parts

    got = jobs.run_available(arriving_in_parts(spark, sf_dir, "scans"), "scans-in-parts")
    want = view(spark, sf_dir, "scans")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
