"""Queries over stored entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import fuzzy_match
from ..sources.bridge import ctes, view
from ..sources.entities import judged_entities, parsed_entities
from .registry import query


_WHOLE = "id % 13 <> 0 AND id % 17 <> 0"


@query(f"""WITH {ctes('scans')} SELECT CASE WHEN NOT whole THEN NULL ELSE id::VARCHAR END AS id, CASE WHEN NOT whole OR id % 7 = 0 THEN NULL ELSE url END AS url, CASE WHEN NOT whole OR id % 5 = 0 THEN NULL ELSE score END AS score, CASE WHEN NOT whole THEN NULL ELSE date_trunc('millisecond', created_at) END AS scanned_at,
  CASE WHEN NOT whole THEN 'id,project_id,url,score,sub_scores,scanned_at' ELSE concat_ws(',', CASE WHEN id % 7 = 0 THEN 'url' END, CASE WHEN id % 5 = 0 THEN 'score' END) END AS missing FROM (SELECT *, {_WHOLE} AS whole FROM scans)""")
def io1_scan_history(spark, sf_dir):
    """Scans as lines of JSON: some without a url, some with a score that is no number, some cut off."""
    rows = parsed_entities(_lines(spark, sf_dir), "scan_history")
    return rows.select("id", "url", "score", F.col("scanned_at").cast("timestamp_ntz").alias("scanned_at"), F.array_join("missing", ",").alias("missing"))


def _lines(spark, sf_dir):
    n = F.col("id")
    fields = F.struct(n.cast("string").alias("id"), F.col("project_id").cast("string").alias("project_id"), F.when(n % 7 != 0, F.col("url")).alias("url"), F.when(n % 5 == 0, "high").otherwise(F.col("score").cast("string")).alias("score"), F.lit("{}").alias("sub_scores"), F.col("created_at").alias("scanned_at"), F.when(n % 11 == 0, "x").alias("more"))
    line = F.regexp_replace(F.to_json(fields), r'"score":"(\d+)"', '"score":$1')
    return view(spark, sf_dir, "scans").select(n.alias("line"), F.when(n % 13 == 0, F.substring(line, F.lit(1), F.lit(9))).when(n % 17 == 0, F.concat(F.lit("["), line, F.lit("]"))).otherwise(line).alias("value"))


def _rejected(spark, sf_dir, *why):
    rows = judged_entities(_lines(spark, sf_dir), "scan_history").select("line", F.explode("reasons").alias("r"))
    return rows.where(F.col("r.reason").isin(*why)).select("line", "r.field", "r.reason")


@query(f"WITH {ctes('scans')} SELECT id AS line, '' AS field, CASE WHEN id % 13 = 0 THEN 'no JSON' ELSE 'no object' END AS reason FROM scans WHERE NOT ({_WHOLE})")
def io1_unreadable_rows(spark, sf_dir):
    return _rejected(spark, sf_dir, "no JSON", "no object")


@query(f"WITH {ctes('scans')} SELECT id AS line, 'url' AS field, 'lacking' AS reason FROM scans WHERE {_WHOLE} AND id % 7 = 0")
def io1_lacking_fields(spark, sf_dir):
    return _rejected(spark, sf_dir, "lacking")


@query(f"WITH {ctes('scans')} SELECT id AS line, 'score' AS field, 'of another type' AS reason FROM scans WHERE {_WHOLE} AND id % 5 = 0 UNION ALL SELECT id, 'more', 'unknown' FROM scans WHERE {_WHOLE} AND id % 11 = 0")
def io1_other_fields(spark, sf_dir):
    return _rejected(spark, sf_dir, "of another type", "unknown")


@query("""WITH n AS (SELECT s_suppkey AS id, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower('The SUPPLIER: ' || s_suppkey % 10 || '!'), '[^a-z0-9]+', ' ', 'g')) AS b, trim(regexp_replace(lower(s_name || ', Inc.'), '[^a-z0-9]+', ' ', 'g')) AS c FROM supplier)
SELECT id, a = b OR contains(a, b) OR contains(b, a) AS near_one, a = c OR contains(a, c) OR contains(c, a) AS near_other FROM n""")
def p29_fuzzy_names(spark, sf_dir):
    name = F.col("s_name")
    one, other = F.concat(F.lit("The SUPPLIER: "), (F.col("s_suppkey") % 10).cast("string"), F.lit("!")), F.concat(name, F.lit(", Inc."))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), fuzzy_match(name, one).alias("near_one"), fuzzy_match(name, other).alias("near_other"))
