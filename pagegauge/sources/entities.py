"""The stored entities with a fixed schema: what a file must hold, and which of its rows do not.

A name ending in ``!`` must not be null. JSON columns stay text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# The columns of the entity tables.
_COLUMNS = {
    "organizations": "id! string, name! string, slug! string, plan_tier! string, stripe_customer_id string, stripe_subscription_id string, crawl_credits_monthly! int, crawl_credits_remaining! int, current_period_end timestamp, settings! string, parent_org_id string, created_at! timestamp, updated_at! timestamp",
    "org_members": "id! string, user_id! string, organization_id! string, role! string",
    "projects": "id! string, organization_id! string, domain! string, name! string, schedule_freq string, last_scheduled_at timestamp, site_score int, site_tier string, created_at! timestamp, updated_at! timestamp",
    "scans": "id! string, project_id string, url! string, hash! string, score! int, tier! string, sub_scores! string, layer_scores! string, extraction! string, fixes! string, citation_simulation! string, robots_data! string, page_type string, raw_text string, content_hash string, competitor_data string, crawl_job_id string, factor_version! int, created_at! timestamp",
    "scan_history": "id! string, project_id! string, url! string, score! int, prev_score int, sub_scores! string, scanned_at! timestamp",
    "crawl_jobs": "id! string, project_id! string, status! string, pages_total! int, pages_completed! int, pages_skipped! int, credits_used! int, max_pages int, is_incremental! boolean, delta_report string, site_score int, started_at timestamp, completed_at timestamp, created_at! timestamp",
    "api_keys": "id! string, organization_id! string, key_hash! string, label! string, rate_limit! int, scopes! array<string>, last_used_at timestamp, created_at! timestamp",
    "webhooks": "id! string, organization_id! string, url! string, events! array<string>, secret! string, active! boolean, failure_count! int, last_triggered_at timestamp, created_at! timestamp",
    "alerts": "id! string, organization_id! string, project_id string, type! string, severity! string, title! string, message! string, url string, metadata! string, read_at timestamp, created_at! timestamp",
    "users": "id! string, email! string, name string, role! string, created_at! timestamp",
}


def schema_of(entity: str) -> StructType:
    """The schema of an entity; a field that must not be null says so."""
    plain = StructType.fromDDL(_COLUMNS[entity].replace("!", ""))
    needed = {part.split()[0].rstrip("!") for part in _COLUMNS[entity].split(", ") if "!" in part}
    return StructType([StructField(f.name, f.dataType, f.name not in needed) for f in plain.fields])


def missing(entity: str) -> Column:
    """The names of a row's fields that must not be null but are, in order; empty for a good row."""
    return F.array_compact(F.array(*(F.when(F.col(f.name).isNull(), F.lit(f.name)) for f in schema_of(entity).fields if not f.nullable)))


def read_entities(spark: SparkSession, entity: str, path: str, file_format: str = "parquet") -> DataFrame:
    """IO1: the rows of an entity with ``missing``; fields a file lacks, or whose JSON value is of another type, are null."""
    rows = spark.read.schema(schema_of(entity)).format(file_format).load(path)
    return rows.withColumn("missing", missing(entity))


def parsed_entities(lines: DataFrame, entity: str, value: str = "value") -> DataFrame:
    """IO1: entities that come as JSON, one to a row, with ``missing``; what is no JSON lacks everything."""
    return lines.select(F.from_json(value, schema_of(entity)).alias("e")).select("e.*").withColumn("missing", missing(entity))


def judged_entities(lines: DataFrame, entity: str, value: str = "value") -> DataFrame:
    """IO1: as ``parsed_entities``, with ``reasons`` why a row is rejected: struct(field, reason), in the order of the schema; a good row has none.

    Reasons: ``no JSON`` and ``no object`` (of the whole row, field empty), ``lacking`` (a field that must be there is absent or null), ``of another type``, ``unknown`` (a field that the
    schema has not, last). A line is parsed to a VARIANT beside its typed reading, so that what a typed null hides is told apart.
    """
    found = F.try_variant_get(F.try_parse_json(value), "$", "map<string,variant>")
    rows = lines.withColumns({"found": found, "is JSON": F.try_parse_json(value).isNotNull(), "e": F.from_json(value, schema_of(entity))})
    at = lambda name: F.col("found")[name]
    there = lambda name: at(name).isNotNull() & ~F.coalesce(F.is_variant_null(at(name)), F.lit(True))
    reason = lambda field, why: F.struct(F.lit(field).alias("field"), F.lit(why).alias("reason"))
    own = [F.when(there(f.name), F.when(F.col(f"e.{f.name}").isNull(), reason(f.name, "of another type"))).when(F.lit(not f.nullable), reason(f.name, "lacking")) for f in schema_of(entity).fields]
    known = F.array(*(F.lit(f.name) for f in schema_of(entity).fields))
    unknown = F.transform(F.array_sort(F.array_except(F.map_keys("found"), known)), lambda k: F.struct(k.alias("field"), F.lit("unknown").alias("reason")))
    whole = F.when(~F.col("is JSON"), F.array(reason("", "no JSON"))).when(F.col("found").isNull(), F.array(reason("", "no object")))
    reasons = F.coalesce(whole, F.concat(F.array_compact(F.array(*own)), unknown))
    return rows.withColumn("reasons", reasons).select(*lines.columns, "e.*", "reasons")
