"""Lookups with expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TTL_DAYS = 30


def cached_authority(domains: DataFrame, cache: DataFrame, as_of: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """Domains beside their cached authority where it has not expired; ``refresh`` where there is none."""
    key = lambda df: df.withColumn("domain", F.lower(F.trim("domain")))
    live = key(cache).withColumn("expires_at", F.timestamp_add("DAY", F.lit(ttl_days), F.col("fetched_at"))).where(F.col("expires_at") >= as_of)
    newest = live.groupBy("domain").agg(F.max_by(F.struct("authority", "expires_at"), "fetched_at").alias("x")).select("domain", "x.*")
    return key(domains).distinct().join(newest, "domain", "left").withColumn("refresh", F.col("expires_at").isNull())
