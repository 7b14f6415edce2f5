"""The histogram and the export over more scans than the reference's page of 10,000."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegauge.operators import tenants


def test_all_scans_are_counted_and_exported(spark):
    n = 10_050
    scans = spark.range(n).select(F.col("id").cast("string").alias("id"), (F.col("id") % 100).cast("int").alias("score"), F.timestamp_seconds("id").alias("created_at"), F.lit("u").alias("url"), F.lit("free").alias("tier"), F.lit("1").alias("factor_version"), F.lit("p").alias("project_id"))
    assert sum(r["n"] for r in tenants.score_histogram(scans).collect()) == n
    assert sum(r["n"] for r in tenants.score_histogram(scans, 20).collect()) == 20
    projects = spark.createDataFrame([("p", "P", "d", "o")], "id string, name string, domain string, organization_id string")
    orgs = spark.createDataFrame([("o", "O")], "id string, name string")
    assert tenants.scans_export(scans, projects, orgs).count() == n
