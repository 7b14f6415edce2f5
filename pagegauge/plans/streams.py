"""Queries that run the streaming jobs over all rows that have arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.bridge import AS_OF, arriving_in_parts, ctes
from ..streaming import jobs
from .logs import _PARSED
from .registry import query
from .scoring import _alert_sql


@query(f"WITH {_PARSED} SELECT ts::DATE::VARCHAR AS day, bot, count(*) AS visits FROM visits GROUP BY ALL")
def t1_visit_stream(spark, sf_dir):
    counts = jobs.visits_per_day(arriving_in_parts(spark, sf_dir, "log_lines"), F.expr(f"TIMESTAMP '{AS_OF}'"))
    return jobs.run_available(counts, "visit-stream", ("day", "bot")).withColumn("day", F.col("day").cast("string"))


@query(_alert_sql())
def t2_alert_stream(spark, sf_dir):
    return jobs.run_available(jobs.alert_stream(arriving_in_parts(spark, sf_dir, "scans")), "alert-stream").drop("project_id", "created_at")


@query(f"WITH {ctes('scans')}, q AS (SELECT *, lag(content_hash) OVER (PARTITION BY project_id, url ORDER BY created_at, id) AS before FROM scans) SELECT id, project_id, url, content_hash FROM q WHERE before IS NULL OR content_hash IS NULL OR content_hash <> before")
def t3_changed_page_stream(spark, sf_dir):
    pages = arriving_in_parts(spark, sf_dir, "scans").select("project_id", "url", "content_hash", F.col("created_at").alias("ts"), F.col("id").alias("seq"))
    return jobs.run_available(jobs.changed_page_stream(pages), "changed-page-stream").select(F.col("seq").alias("id"), "project_id", "url", "content_hash")
