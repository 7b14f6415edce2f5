"""Queries over scans, crawls and fixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import SUB_SCORES
from ..operators import sites
from ..sources import readers
from ..sources.bridge import ctes, view
from .registry import query

_SUBS = ", ".join(SUB_SCORES)
_LATEST = f"{ctes('scans')}, latest AS (SELECT * FROM scans QUALIFY row_number() OVER (PARTITION BY project_id, url ORDER BY created_at DESC, id DESC) = 1)"
_TIER = "CASE WHEN x >= 90 THEN 'authority' WHEN x >= 70 THEN 'extractable' WHEN x >= 40 THEN 'readable' ELSE 'invisible' END"


def _tier(x: str) -> str:
    return _TIER.replace("x >=", f"{x} >=")


@query(f"WITH {_LATEST} SELECT project_id, url, id, score, page_type, created_at FROM latest")
def w1_latest_scan(spark, sf_dir):
    return sites.latest_scans(view(spark, sf_dir, "scans"), columns=("id", "score", "page_type", "created_at"))


def _pages(spark, sf_dir, *columns):
    return sites.latest_scans(view(spark, sf_dir, "scans"), columns=("page_type", "score", *columns))


@query(f"""WITH {_LATEST}, s AS (SELECT project_id, floor(sum(score * w) / sum(w)::DOUBLE + 0.5)::BIGINT AS site_score FROM (SELECT *, CASE WHEN page_type = 'homepage' THEN 2 ELSE 1 END AS w FROM latest) GROUP BY project_id)
SELECT project_id, site_score, {_tier('site_score')} AS site_tier FROM s""")
def a1_site_score(spark, sf_dir):
    return sites.site_scores(_pages(spark, sf_dir))


@query(f"WITH {_LATEST} SELECT project_id, floor(avg(score) + 0.5)::BIGINT AS avg_score, count(*) AS total_pages FROM latest GROUP BY project_id")
def a2_page_means(spark, sf_dir):
    return sites.page_means(_pages(spark, sf_dir))


@query(f"""WITH {_LATEST} SELECT project_id, count(*) FILTER (score >= 90) AS authority, count(*) FILTER (score BETWEEN 70 AND 89) AS extractable, count(*) FILTER (score BETWEEN 40 AND 69) AS readable, count(*) FILTER (score < 40) AS invisible
FROM latest GROUP BY project_id""")
def a3_tier_counts(spark, sf_dir):
    return sites.tier_counts(_pages(spark, sf_dir))


# of some pages a sub-score is not stored, of others one that no list has, or no sub-scores at all
@query(f"""WITH {_LATEST}, long AS (UNPIVOT (SELECT project_id, id, {', '.join(f'{c}::BIGINT AS {c}' for c in SUB_SCORES)} FROM latest) ON {_SUBS} INTO NAME sub_score VALUE v),
held AS (SELECT project_id, sub_score, v FROM long WHERE id % 13 <> 0 AND NOT (id % 5 = 0 AND sub_score = 'feed') UNION ALL SELECT project_id, 'accessibility', id % 101 FROM latest WHERE id % 4 = 0 AND id % 13 <> 0)
SELECT project_id, sub_score, floor(sum(v)::DOUBLE / any_value(n) + 0.5)::BIGINT AS average FROM held JOIN (SELECT project_id, count(*) AS n FROM latest GROUP BY project_id) c USING (project_id) GROUP BY ALL""")
def a4_sub_score_means(spark, sf_dir):
    known = [F.when(~((F.col("id") % 5 == 0) & F.lit(c == "feed")), F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))) for c in SUB_SCORES]
    more = F.when(F.col("id") % 4 == 0, F.struct(F.lit("accessibility").alias("key"), (F.col("id") % 101).cast("string").alias("value")))
    entries = F.filter(F.array(*known, more), lambda e: e.isNotNull())
    stored = F.when(F.col("id") % 13 == 0, "{broken").otherwise(F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])), ", "), F.lit("}")))
    pages = _pages(spark, sf_dir, "id", *SUB_SCORES).select("project_id", readers.parsed_scores(stored).alias("sub_scores"))
    return sites.sub_score_means(pages)


@query(f"""WITH {_LATEST}, rules(rule, col, least, description) AS (VALUES (0, 'faq', 20, 'Missing FAQ/Q&A content'), (1, 'schema', 30, 'Missing or minimal structured data'), (2, 'summary', 30, 'No meta description or front-loaded summary'),
  (3, 'feed', 20, 'Missing sitemap/feed references'), (4, 'entity', 30, 'Low entity density'), (5, 'structure', 40, 'Poor heading hierarchy or content structure'), (6, 'crawlAccess', 50, 'Crawl access issues (missing canonical, noindex, etc.)')),
long AS (UNPIVOT (SELECT project_id, {', '.join(f'{c}::BIGINT AS {c}' for c in SUB_SCORES)} FROM latest) ON {_SUBS} INTO NAME col VALUE v),
g AS (SELECT project_id, rule, description, count(*) FILTER (v < least) AS affected_pages, count(*) AS total_pages FROM long JOIN rules USING (col) GROUP BY ALL)
SELECT project_id, description, affected_pages, total_pages, floor(affected_pages::DOUBLE / total_pages * 100 + 0.5)::BIGINT AS percentage, row_number() OVER (PARTITION BY project_id ORDER BY affected_pages DESC, rule)::INTEGER AS position FROM g WHERE affected_pages > 0""")
def a5_issue_prevalence(spark, sf_dir):
    return sites.issue_prevalence(_pages(spark, sf_dir, *SUB_SCORES))


@query(f"""WITH {ctes('fixes')}, g AS (SELECT site, factor_id, substr(description, 1, 50) AS p, count(*) AS affected_pages, sum(points)::BIGINT AS total_impact, arg_min(description, page_id * 1000 + ord) AS description, arg_min(layer, page_id * 1000 + ord) AS layer, min(page_id * 1000 + ord) AS o FROM fixes GROUP BY ALL)
SELECT site, factor_id, description, layer, floor(total_impact::DOUBLE / affected_pages + 0.5)::BIGINT AS avg_points, affected_pages, total_impact, position::INTEGER AS position
FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY total_impact DESC, o) AS position FROM g) WHERE position <= 20""")
def a6_priority_fixes(spark, sf_dir):
    # the first page's text: groups mix the flags of a line, which lie behind the prefix; of equal lines the one that stands first in the table
    place = {"ord": F.col("page_id") * 1000 + F.col("ord"), "file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")}
    fixes = view(spark, sf_dir, "fixes").withColumns(place)
    return sites.priority_fixes(fixes, "site", ("ord", "file", "row"))


@query(f"WITH {ctes('fixes')} SELECT page_id, factor_id, points, description, row_number() OVER (PARTITION BY page_id ORDER BY points DESC, ord, description)::INTEGER AS priority FROM fixes")
def w6_fix_order(spark, sf_dir):
    return sites.ordered_fixes(view(spark, sf_dir, "fixes"), "page_id", "ord").select("page_id", "factor_id", "points", "description", "priority")


@query(f"""WITH {ctes('fixes')}, p AS (SELECT o_orderkey AS page_id, (floor(o_totalprice)::BIGINT % 101) AS score FROM orders)
SELECT p.page_id, p.score, least(100, p.score + coalesce(f.n, 0))::BIGINT AS projected_score FROM p LEFT JOIN (SELECT page_id, sum(points)::BIGINT AS n FROM fixes GROUP BY page_id) f USING (page_id)""")
def a21_projected_score(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("page_id"), (F.floor("o_totalprice") % 101).alias("score"))
    return sites.projected_scores(pages, view(spark, sf_dir, "fixes"), "page_id")


@query(f"WITH {ctes('crawl_jobs')} SELECT id, pages_completed::BIGINT AS completed, pages_skipped::BIGINT AS skipped, (pages_completed + pages_skipped)::BIGINT AS total, pages_completed::BIGINT AS credits_used FROM crawl_jobs")
def a26_crawl_counters(spark, sf_dir):
    return sites.crawl_counters(view(spark, sf_dir, "crawl_jobs"))


@query(f"WITH {ctes('scans')} SELECT id, project_id, url, score, lag(score) OVER (PARTITION BY project_id, url ORDER BY created_at, id) AS prev_score FROM scans")
def j1_previous_scan(spark, sf_dir):
    return sites.with_previous(view(spark, sf_dir, "scans"), "score").select("id", "project_id", "url", "score", "prev_score")


_SPLIT = f"{ctes('scans')}, old AS (SELECT * FROM scans WHERE created_at < TIMESTAMP '2024-01-25' QUALIFY row_number() OVER (PARTITION BY project_id, url ORDER BY created_at DESC, id DESC) = 1), cur AS (SELECT * FROM scans WHERE created_at >= TIMESTAMP '2024-01-25' QUALIFY row_number() OVER (PARTITION BY project_id, url ORDER BY created_at DESC, id DESC) = 1)"


def _crawl(spark, sf_dir):
    """A crawl since the 25th, and the scans stored before it."""
    scans, start = view(spark, sf_dir, "scans"), F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00'")
    return sites.latest_scans(scans.where(F.col("created_at") >= start), columns=("id", "score", "content_hash")), scans.where(F.col("created_at") < start)


@query(f"""WITH {_SPLIT} SELECT c.project_id, c.url, c.score, o.score AS previous_score, c.score - o.score AS delta, CASE WHEN o.score IS NULL THEN 'new' WHEN c.score > o.score THEN 'improved' ELSE 'declined' END AS change
FROM cur c LEFT JOIN old o ON c.project_id = o.project_id AND c.url = o.url WHERE o.score IS NULL OR c.score <> o.score""")
def j2_crawl_delta(spark, sf_dir):
    current, stored = _crawl(spark, sf_dir)
    return sites.crawl_delta(current, sites.latest_scans(stored, columns=("score",)))


@query(f"WITH {_SPLIT} SELECT c.project_id, c.url, c.id, c.content_hash FROM cur c LEFT JOIN old o ON c.project_id = o.project_id AND c.url = o.url AND c.content_hash = o.content_hash WHERE o.id IS NULL")
def j3_incremental_skip(spark, sf_dir):
    current, stored = _crawl(spark, sf_dir)
    return sites.changed_pages(current, stored).select("project_id", "url", "id", "content_hash")


@query(f"""WITH {ctes('projects', 'scans')}, l AS (SELECT * FROM scans QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) = 1)
SELECT p.id, p.domain, p.updated_at, l.score AS last_score, CASE WHEN l.score IS NOT NULL THEN {_tier('l.score')} END AS last_tier, l.created_at AS last_scan_at FROM projects p LEFT JOIN l ON p.id = l.project_id""")
def w2_latest_per_project(spark, sf_dir):
    return sites.latest_per_project(view(spark, sf_dir, "projects").select("id", "domain", "updated_at"), view(spark, sf_dir, "scans"))


@query(f"WITH {ctes('scans')} SELECT project_id, url, score, created_at, position::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) AS position FROM scans) WHERE position <= 100")
def w3_history(spark, sf_dir):
    return sites.history(view(spark, sf_dir, "scans")).select("project_id", "url", "score", "created_at", "position")


@query(f"""WITH {ctes('scans', 'crawl_jobs', 'projects', 'organizations')}, b AS (SELECT p.id, least(coalesce(j.max_pages, 100), o.crawl_credits_remaining) AS budget FROM projects p JOIN organizations o ON o.id = p.organization_id
  JOIN (SELECT * FROM crawl_jobs QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) = 1) j ON j.project_id = p.id)
SELECT project_id, id, url, position::INTEGER AS position FROM (SELECT s.project_id, s.id, s.url, b.budget, row_number() OVER (PARTITION BY s.project_id ORDER BY s.score DESC, s.id) AS position FROM scans s JOIN b ON b.id = s.project_id) WHERE position <= budget""")
def w5_crawl_budget(spark, sf_dir):
    jobs = sites.newest_jobs(view(spark, sf_dir, "crawl_jobs"), "project_id", 1).select("project_id", "max_pages")
    orgs = view(spark, sf_dir, "organizations").select(F.col("id").alias("organization_id"), "crawl_credits_remaining")
    budget = F.least(F.coalesce("max_pages", F.lit(100)), F.col("crawl_credits_remaining")).alias("budget")
    budgets = view(spark, sf_dir, "projects").join(orgs, "organization_id").join(jobs, F.col("id") == F.col("project_id")).select("project_id", budget)
    pages = view(spark, sf_dir, "scans").join(budgets, "project_id")
    return sites.within_budget(pages, "project_id", [F.coalesce(-F.col("score"), F.lit(1)), F.floor(F.col("id") / 4096)], [F.desc("score"), F.col("id")], F.col("budget")).select("project_id", "id", "url", "position")


@query(f"WITH {ctes('crawl_jobs')} SELECT project_id, id, status, created_at, position::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS position FROM crawl_jobs) WHERE position <= 20")
def w8_newest_jobs(spark, sf_dir):
    return sites.newest_jobs(view(spark, sf_dir, "crawl_jobs"), "project_id", 20).select("project_id", "id", "status", "created_at", "position")


@query(f"WITH {ctes('scans')} SELECT project_id, id, url, score, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, url, id)::INTEGER AS position FROM scans")
def l2_result_pages(spark, sf_dir):
    """The pages of each project's crawl, best first."""
    return sites.within_budget(view(spark, sf_dir, "scans"), "project_id", [F.coalesce(-F.col("score"), F.lit(1))], [F.desc("score"), F.col("url"), F.col("id")], F.lit(1 << 30)).select("project_id", "id", "url", "score", "position")
