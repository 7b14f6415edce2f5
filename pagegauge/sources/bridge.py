"""The library's input tables as views over the driver's tables, in SQL that Spark and DuckDB share.

``{name}`` stands for a table of the driver, ``{ts}`` for the engine's timestamp without a zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import SUB_SCORES
from .stored import new_path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
AS_OF = "2024-01-31 00:00:00"
#: The factor of each sub-score's made-up value.
_FACTORS = dict(zip(SUB_SCORES, (7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53), strict=True))
#: A made-up speakable score is 0 or 100, as a real one is.
_SUBS = ", ".join(
    f"CAST(CASE WHEN event_id % 3 = 0 THEN 100 ELSE 0 END AS INT) AS {name}" if name == "speakable" else f"CAST((event_id * {k} + CAST(floor(value) AS BIGINT)) % 101 AS INT) AS {name}"
    for name, k in _FACTORS.items()
)
_AGENTS = (
    "Mozilla/5.0 (compatible; GPTBot/1.2)", "Mozilla/5.0 (compatible; ClaudeBot/1.0)", "anthropic-ai/1.0", "Mozilla/5.0 (compatible; PerplexityBot/1.0)", "Google-Extended",
    "Mozilla/5.0 (compatible; Googlebot/2.1)", "Mozilla/5.0 (compatible; bingbot/2.0)", "ChatGPT-User/1.0", "Bytespider", "CCBot/2.0", "Applebot/0.1", "Meta-ExternalAgent/1.1",
    "Googlebot-Image/1.0", "Mozilla/5.0 (X11; Linux) Firefox/120",
)
_AGENT = " ".join(f"WHEN {k} THEN '{a}'" for k, a in enumerate(_AGENTS))
_PLAN = "CASE c_mktsegment WHEN 'BUILDING' THEN 'pro' WHEN 'FURNITURE' THEN 'agency' WHEN 'HOUSEHOLD' THEN 'enterprise' ELSE 'free' END"

VIEWS = {
    "scans": f"""SELECT event_id AS id, user_id AS project_id, 'https://site' || CAST(user_id AS STRING) || '.example.com/' || event_type AS url,
        CAST(least(100, floor(value)) AS INT) AS score, CASE WHEN event_type = 'signup' THEN 'homepage' ELSE 'page' END AS page_type, ts AS created_at,
        md5(event_type || CAST(CAST(floor(value) AS BIGINT) % 5 AS STRING)) AS content_hash, CAST(event_id % 2 = 0 AS BOOLEAN) AS has_author, CAST(event_id % 5 < 2 AS BOOLEAN) AS has_fresh_date, {_SUBS} FROM {{events}}""",
    "log_lines": f"""SELECT event_id, '10.0.' || CAST(user_id % 200 AS STRING) || '.' || CAST(event_id % 250 AS STRING) || ' - - [' || substr(CAST(ts AS STRING), 9, 2) || '/Jan/' || substr(CAST(ts AS STRING), 1, 4) || ':' || substr(CAST(ts AS STRING), 12, 8)
        || CASE WHEN event_id % 10 = 3 THEN ' -0700' ELSE ' +0000' END || '] "GET /' || event_type || '/' || CAST(event_id % 50 AS STRING) || ' HTTP/1.1" ' || CASE WHEN event_id % 17 = 0 THEN '404' ELSE '200' END || ' 512 "-" "' || CASE event_id % 14 {_AGENT} END || '"' AS value FROM {{events}}""",
    "organizations": f"""SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', '-')) AS slug, plan_tier, CASE WHEN c_custkey % 10 <> 0 AND parent_plan IN ('agency', 'enterprise') THEN c_custkey - c_custkey % 10 END AS parent_org_id,
        monthly AS crawl_credits_monthly, CAST(abs(floor(c_acctbal)) AS BIGINT) % (monthly + 1) AS crawl_credits_remaining, CASE WHEN plan_tier <> 'free' AND c_custkey % 3 <> 0 THEN 'sub_' || CAST(c_custkey AS STRING) END AS stripe_subscription_id,
        CAST(DATE '2024-01-31' + CAST(c_custkey % 40 AS INT) AS {{ts}}) AS current_period_end, CAST(DATE '2024-01-31' - CAST(c_custkey % 60 AS INT) AS {{ts}}) AS created_at
        FROM (SELECT c.*, p.plan_tier AS parent_plan, CAST(CASE c.plan_tier WHEN 'free' THEN 5 WHEN 'pro' THEN 5000 WHEN 'agency' THEN 25000 ELSE 100000 END AS BIGINT) AS monthly
          FROM (SELECT *, {_PLAN} AS plan_tier FROM {{customer}}) c LEFT JOIN (SELECT c_custkey AS k, {_PLAN} AS plan_tier FROM {{customer}}) p ON p.k = c.c_custkey - c.c_custkey % 10) x""",
    "projects": """SELECT p_partkey AS id, p_partkey % (SELECT count(*) FROM {customer}) AS organization_id, lower(replace(p_name, ' ', '-')) || CAST(p_partkey AS STRING) || '.com' AS domain, p_name AS name,
        CASE p_size % 4 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' WHEN 2 THEN 'monthly' END AS schedule_freq, CASE WHEN p_size % 5 <> 0 THEN CAST(DATE '2024-01-31' - CAST(p_size AS INT) AS {ts}) END AS last_scheduled_at,
        CASE WHEN p_size % 7 <> 0 THEN CAST((p_size * 2) % 101 AS INT) END AS site_score, CAST(DATE '2024-01-31' - CAST(p_partkey % 90 AS INT) AS {ts}) AS updated_at FROM {part}""",
    "crawl_jobs": """SELECT o_orderkey AS id, o_custkey % (SELECT count(*) FROM {part}) AS project_id, CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 3 = 0 THEN 'failed' WHEN o_orderkey % 97 = 0 THEN 'running' WHEN o_orderkey % 89 = 0 THEN 'pending' ELSE 'completed' END AS status,
        CAST(floor(o_totalprice) AS BIGINT) % 60 AS pages_completed, CAST(floor(o_totalprice) AS BIGINT) % 13 AS pages_skipped, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 50 END AS INT) AS max_pages, o_orderdate AS created_at FROM {orders}""",
    "users": """SELECT s_suppkey AS id, 'user' || CAST(s_suppkey AS STRING) || '@example.com' AS email, s_name AS name, CASE WHEN s_suppkey % 10 = 0 THEN 'admin' ELSE 'user' END AS role, CAST(DATE '2024-01-31' - CAST(s_suppkey % 45 AS INT) AS {ts}) AS created_at FROM {supplier}""",
    "org_members": """SELECT s_suppkey AS user_id, (s_suppkey * 7) % (SELECT count(*) FROM {customer}) AS organization_id, CASE WHEN s_suppkey % 4 = 0 THEN 'member' WHEN s_suppkey % 4 = 1 THEN 'owner' ELSE 'admin' END AS role FROM {supplier}
        UNION ALL SELECT s_suppkey, (s_suppkey * 13 + 5) % (SELECT count(*) FROM {customer}), 'member' FROM {supplier} WHERE s_suppkey % 3 = 0""",
    "fixes": """SELECT l_orderkey AS page_id, l_suppkey AS site, CAST(l_linenumber AS STRING) AS factor_id, CAST(floor(l_quantity) AS BIGINT) AS points, 'Improve the ' || l_returnflag || ' signal of this page, a factor of group ' || l_linestatus || ' in position ' || CAST(l_linenumber AS STRING) AS description,
        CASE WHEN l_linenumber % 3 = 0 THEN 'access' WHEN l_linenumber % 3 = 1 THEN 'understanding' ELSE 'extractability' END AS layer, l_linenumber AS ord FROM {lineitem}""",
    "probe_results": """SELECT 'https://s' || CAST(s_suppkey AS STRING) || '.example.com/' AS url, agent, CAST(CASE WHEN (s_suppkey * 3 + k * 7) % 11 = 0 THEN 403 WHEN (s_suppkey + k * 5) % 13 = 0 THEN 500 WHEN (s_suppkey + k) % 17 = 0 THEN 0 WHEN (s_suppkey + k) % 19 = 0 THEN 404 ELSE 200 END AS INT) AS status
        FROM {supplier} CROSS JOIN (SELECT 0 AS k, 'browser' AS agent UNION ALL SELECT 1, 'GPTBot' UNION ALL SELECT 2, 'ClaudeBot' UNION ALL SELECT 3, 'PerplexityBot' UNION ALL SELECT 4, 'Googlebot' UNION ALL SELECT 5, 'Bingbot') a""",
    "domain_signals": """SELECT 's' || CAST(s_suppkey AS STRING) || '.example.com' AS domain, signal, CAST((s_suppkey * m) % 4 <> 0 AS BOOLEAN) AS found, CAST((s_suppkey * m + CAST(floor(abs(s_acctbal)) AS BIGINT)) % 101 AS INT) AS score
        FROM {supplier} CROSS JOIN (SELECT 3 AS m, 'kg' AS signal UNION ALL SELECT 5, 'wikidata' UNION ALL SELECT 7, 'backlinks') a""",
    "webhooks": """SELECT c_custkey AS id, c_custkey AS organization_id, 'https://hooks.example.com/' || CAST(c_custkey AS STRING) AS url, CAST(c_custkey % 4 <> 0 AS BOOLEAN) AS active, CASE WHEN c_custkey % 2 = 0 THEN 'score_drop,tier_change' ELSE 'score_drop,score_improvement,new_issue' END AS events FROM {customer}""",
}


def _sql(name: str, table, ts: str) -> str:
    return VIEWS[name].format(**{t: table(t) for t in TABLES}, ts=ts)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_sql(name, lambda t: f"parquet.`{sf_dir}/{t}.parquet`", "TIMESTAMP_NTZ"))


#: Micro-batches of a table that arrives in parts.
PARTS = 4
#: Rows of a file of a part, about.
FILE_ROWS = 50_000


def arriving_in_parts(spark: SparkSession, sf_dir: str, name: str, parts: int = PARTS) -> DataFrame:
    """A view over ``events`` as a stream: the table as it came in over time, in parts of about equal size, each a micro-batch. A large part is many files, so that no task has all of it.

    A micro-batch takes a number of files, so each part has that number: it is chosen by the smallest part, so small that no file of it is without rows.
    """
    events, path = spark.read.parquet(f"{sf_dir}/events.parquet"), new_path(spark, "arriving")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []
    part = F.lit(0)
    for cut in cuts:
        part = part + F.when(at > cut, 1).otherwise(0)
    sizes = {r["part"]: r["count"] for r in events.groupBy(part.alias("part")).count().collect()}
    files = max(1, min(sizes.get(k, 0) for k in range(parts)) // FILE_ROWS)
    for k in range(parts):  # one after another, as a stream takes files by their age
        rows = events.where(part == k)
        # dealt row by row, so an input partition of as many rows as files reaches each file
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)
    stream.createOrReplaceTempView("arriving_events")
    return spark.sql(_sql(name, lambda t: f"arriving_{t}", "TIMESTAMP_NTZ"))


def ctes(*names: str) -> str:
    """The views as DuckDB table expressions, to stand after WITH."""
    return ",\n".join(f"{n} AS ({_sql(n, lambda t: t, 'TIMESTAMP')})" for n in names)
