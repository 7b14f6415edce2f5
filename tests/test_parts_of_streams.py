"""A large part of an arriving table is many files of one micro-batch, and the log is parsed once."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegauge.operators import logs
from pagegauge.sources import bridge
from pagegauge.streaming import jobs


def test_each_micro_batch_has_as_many_files(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(bridge, "FILE_ROWS", 60)
    # skewed in time: nine tenths of the rows come within an hour
    rows = spark.range(1000).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, IF(id < 100, CAST(id % 20 AS INT), 20), 0, 0, IF(id < 100, 0, id))").alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    path = bridge.arriving_in_parts(spark, str(tmp_path), "scans")
    files = {}
    query = path.writeStream.foreachBatch(lambda batch, n: files.update({n: (len(batch.inputFiles()), batch.count(), batch.agg(F.min("created_at"), F.max("created_at")).first())})).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    assert len(files) == bridge.PARTS and sum(n for _, n, _ in files.values()) == 1000
    assert all(n >= 200 for _, n, _ in files.values()) and all(files[k][2][1] < files[k + 1][2][0] for k in range(bridge.PARTS - 1))


def test_few_or_equal_times_are_all_there(spark, tmp_path):
    for k, n in enumerate((0, 1, 3)):
        spark.range(n).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00'").alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).write.parquet(f"{tmp_path}/{k}/events.parquet")
        assert jobs.run_available(bridge.arriving_in_parts(spark, f"{tmp_path}/{k}", "scans"), "few").count() == n


def test_a_line_is_matched_once(spark):
    line = '1.2.3.4 - - [05/Jan/2024:10:00:00 +0000] "GET /a HTTP/1.1" 200 5 "-" "GPTBot"'
    rows = spark.createDataFrame([(1, line), (2, "no log line"), (3, ""), (4, None), (5, line.replace("GPTBot", "Firefox"))], "n int, value string")
    found = logs.visits(rows, F.lit("2024-01-31").cast("timestamp"))
    assert [(r["n"], r["url"], r["status"], r["bot"]) for r in found.collect()] == [(1, "/a", 200, "GPTBot")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(logs.COMBINED) == 1
