"""Queries over tenants, plans, credits, listings, exports and urls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import tier_of
from ..operators import listing, tenants
from ..sources.bridge import AS_OF, ctes, view
from .registry import query

_ORGS = ctes("organizations")
_TIER = "CASE WHEN score >= 90 THEN 'authority' WHEN score >= 70 THEN 'extractable' WHEN score >= 40 THEN 'readable' ELSE 'invisible' END"
_TIERED = f"{ctes('scans')}, t AS (SELECT *, {_TIER} AS tier FROM scans)"


def _as_of():
    return F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")


def _scans(spark, sf_dir):
    return view(spark, sf_dir, "scans").withColumn("tier", tier_of(F.col("score")))


def _v(spark, sf_dir, *names):
    return [view(spark, sf_dir, n) for n in names]


@query(f"WITH {_TIERED} SELECT id, url, tier, score FROM t WHERE contains(lower(url), 'purch') AND tier = 'extractable'")
def f7_scan_filter(spark, sf_dir):
    return tenants.filtered_scans(_scans(spark, sf_dir), "PURCH", "extractable").select("id", "url", "tier", "score")


@query(f"WITH {_ORGS} SELECT id, name, slug FROM organizations WHERE (contains(lower(name), '00') OR contains(lower(slug), '00')) AND plan_tier = 'pro' AND stripe_subscription_id IS NOT NULL")
def f8_organization_filter(spark, sf_dir):
    return tenants.filtered_organizations(view(spark, sf_dir, "organizations"), "00", "pro", True).select("id", "name", "slug")


@query(f"WITH {_ORGS} SELECT id, plan_tier, current_period_end FROM organizations WHERE stripe_subscription_id IS NOT NULL AND current_period_end BETWEEN TIMESTAMP '2024-01-31' AND TIMESTAMP '2024-02-07'")
def f10_expiring_subscriptions(spark, sf_dir):
    return tenants.expiring(view(spark, sf_dir, "organizations"), _as_of()).select("id", "plan_tier", "current_period_end")


_RAW = "CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 1 THEN 'HTTPS://' || upper(replace(p_name, ' ', '-')) || '.Com/x' WHEN p_partkey % 7 = 2 THEN ' New' || CAST(p_partkey % 50 AS STRING) || '.org ' ELSE lower(replace(p_name, ' ', '-')) || CAST(p_partkey AS STRING) || '.com' END"
_BATCH = f"SELECT p_partkey % 40 AS organization_id, p_partkey AS input_ord, {_RAW} AS raw FROM {{part}}"


def _batch(spark, sf_dir):
    return spark.sql(_BATCH.format(part=f"parquet.`{sf_dir}/part.parquet`"))


_DOMAIN = "regexp_replace(regexp_replace(lower(trim(raw)), '^https?://', ''), '/.*$', '')"


@query(f"WITH b AS ({_BATCH.format(part='part')}) SELECT input_ord, CASE WHEN length({_DOMAIN}) >= 3 THEN {_DOMAIN} END AS domain FROM b")
def f3_domain(spark, sf_dir):
    return _batch(spark, sf_dir).select("input_ord", tenants.normal_domain(F.col("raw")).alias("domain"))


@query(f"WITH {ctes('projects')} SELECT id, regexp_replace(regexp_replace(domain, '\\.[^.]+$', ''), '[^A-Za-z0-9]', ' ', 'g') AS name FROM projects")
def f4_default_name(spark, sf_dir):
    return view(spark, sf_dir, "projects").select("id", tenants.default_name(F.col("domain")).alias("name"))


_SLOTS = f"""{ctes('organizations', 'projects')}, b AS ({_BATCH.format(part='part')}), room AS (SELECT o.id, CASE o.plan_tier WHEN 'enterprise' THEN NULL ELSE greatest(0, CASE o.plan_tier WHEN 'pro' THEN 10 WHEN 'agency' THEN 50 ELSE 0 END - count(p.id)) END AS slots FROM organizations o LEFT JOIN projects p ON p.organization_id = o.id GROUP BY o.id, o.plan_tier),
s AS (SELECT b.*, slots, slots IS NULL OR place <= slots AS fits FROM (SELECT *, row_number() OVER (PARTITION BY organization_id ORDER BY input_ord) AS place FROM b) b JOIN room ON room.id = b.organization_id)"""


@query(f"WITH {_SLOTS} SELECT organization_id, input_ord, fits FROM s")
def w4_import_slots(spark, sf_dir):
    return tenants.within_slots(_batch(spark, sf_dir), *_v(spark, sf_dir, "projects", "organizations")).select("organization_id", "input_ord", "fits")


@query(f"""WITH {_SLOTS}, d AS (SELECT *, CASE WHEN fits AND length({_DOMAIN}) >= 3 THEN {_DOMAIN} END AS domain FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY organization_id, domain ORDER BY input_ord) AS nth FROM d)
SELECT organization_id, input_ord, domain, CASE WHEN NOT fits THEN 'truncated' WHEN domain IS NULL THEN 'Invalid domain' WHEN nth > 1 OR EXISTS (SELECT 1 FROM projects p WHERE p.organization_id = n.organization_id AND p.domain = n.domain) THEN 'Already exists' ELSE 'created' END AS outcome FROM n""")
def j9_bulk_import(spark, sf_dir):
    return tenants.imported(_batch(spark, sf_dir), *_v(spark, sf_dir, "projects", "organizations")).select("organization_id", "input_ord", "domain", "outcome")


@query(f"WITH {_TIERED} SELECT id, url, score FROM t ORDER BY score DESC, id LIMIT 20 OFFSET 40")
def l1_scan_page(spark, sf_dir):
    return tenants.page_of(_scans(spark, sf_dir), "score", ("score", "created_at"), page=3).select("id", "url", "score")


@query(f"WITH {_TIERED} SELECT id, url, created_at FROM t ORDER BY created_at DESC, id LIMIT 50 OFFSET 4000")
def l1_numbered_page(spark, sf_dir):
    """Page 81 of the scans, of which only the days it lies in are sorted."""
    return listing.numbered_page(_scans(spark, sf_dir), "created_at", F.to_date("created_at"), page=81, limit=50).select("id", "url", "created_at")


@query(f"WITH {_TIERED} SELECT id, url, score FROM t WHERE score < 90 OR (score = 90 AND id > 500) ORDER BY score DESC, id LIMIT 25")
def l1_page_after(spark, sf_dir):
    """The scans behind number 500 of score 90."""
    return listing.page_after(_scans(spark, sf_dir), "score", (90, 500), limit=25).select("id", "url", "score")


@query(f"WITH {_TIERED} SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS total_pages FROM t")
def l1_page_meta(spark, sf_dir):
    return tenants.page_meta(_scans(spark, sf_dir))


_PRICE = "CASE plan_tier WHEN 'pro' THEN 49 WHEN 'agency' THEN 199 WHEN 'enterprise' THEN 499 ELSE 0 END"


@query(f"WITH {_ORGS} SELECT plan_tier, count(*) AS n_orgs, sum({_PRICE})::BIGINT AS revenue FROM organizations GROUP BY plan_tier")
def a11_revenue_by_plan(spark, sf_dir):
    return tenants.revenue_by_plan(view(spark, sf_dir, "organizations"))


@query(f"WITH {_ORGS} SELECT sum({_PRICE})::BIGINT AS mrr, (12 * sum({_PRICE}))::BIGINT AS arr FROM organizations")
def a11_recurring_revenue(spark, sf_dir):
    return tenants.recurring_revenue(view(spark, sf_dir, "organizations"))


@query(f"WITH {_ORGS}, c AS (SELECT count(*) AS total, count(stripe_subscription_id) AS paid FROM organizations) SELECT total, paid, floor((total - paid) / total::DOUBLE * 100 + 0.5)::BIGINT AS churn, floor(paid / total::DOUBLE * 100 + 0.5)::BIGINT AS conversion FROM c")
def a12_conversion(spark, sf_dir):
    return tenants.conversion(view(spark, sf_dir, "organizations"))


@query(f"WITH {_ORGS} SELECT sum(crawl_credits_monthly)::BIGINT AS monthly, sum(crawl_credits_remaining)::BIGINT AS remaining, (sum(crawl_credits_monthly) - sum(crawl_credits_remaining))::BIGINT AS used FROM organizations")
def a13_credit_totals(spark, sf_dir):
    return tenants.credit_totals(view(spark, sf_dir, "organizations"))


@query(f"WITH {_TIERED} SELECT tier, floor(avg(score) + 0.5)::BIGINT AS avg_score, count(*) AS n, min(score) AS min_score, max(score) AS max_score FROM t GROUP BY tier")
def a14_scan_statistics(spark, sf_dir):
    return tenants.scan_statistics(_scans(spark, sf_dir))


@query(f"WITH {_TIERED}, l AS (SELECT score FROM t), b AS (SELECT unnest(range(10))::INTEGER AS bucket) SELECT bucket, (bucket * 10) || '-' || (bucket * 10 + 9) AS range, (SELECT count(*) FROM l WHERE score BETWEEN bucket * 10 AND bucket * 10 + 9) AS n FROM b")
def a15_score_histogram(spark, sf_dir):
    return tenants.score_histogram(_scans(spark, sf_dir))


@query(f"WITH {_TIERED} SELECT url, count(*) AS n FROM t GROUP BY url ORDER BY n DESC, url LIMIT 10")
def a16_most_scanned(spark, sf_dir):
    return tenants.most_scanned(_scans(spark, sf_dir))


def _daily(table: str) -> str:
    return f"WITH {ctes(table)}, d AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day) SELECT d.day::VARCHAR AS day, count(s.id) AS n FROM d LEFT JOIN {table} s ON s.created_at::DATE = d.day GROUP BY d.day"


@query(_daily("scans"))
def a17_daily_scans(spark, sf_dir):
    return tenants.daily_counts(view(spark, sf_dir, "scans"), _as_of())


@query(_daily("users"))
def a17_daily_signups(spark, sf_dir):
    return tenants.daily_counts(view(spark, sf_dir, "users"), _as_of())


@query(f"WITH {ctes('crawl_jobs')} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('pending', 'running')) AS queue_depth FROM crawl_jobs")
def a18_job_counts(spark, sf_dir):
    return tenants.job_counts(view(spark, sf_dir, "crawl_jobs"))


@query(f"WITH {ctes('users', 'organizations', 'scans')} SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM organizations) AS organizations, (SELECT count(stripe_subscription_id) FROM organizations) AS paid, (SELECT count(*) FROM scans) AS scans")
def a19_platform_totals(spark, sf_dir):
    return tenants.platform_totals(*_v(spark, sf_dir, "users", "organizations", "scans"))


_SCOPE = f"{ctes('organizations', 'projects', 'crawl_jobs', 'org_members')}, scope AS (SELECT id AS agency_id, id AS organization_id FROM organizations WHERE plan_tier IN ('agency', 'enterprise') UNION ALL SELECT c.parent_org_id, c.id FROM organizations c JOIN organizations a ON a.id = c.parent_org_id AND a.plan_tier IN ('agency', 'enterprise'))"


@query(f"WITH {_SCOPE} SELECT s.agency_id, s.organization_id, p.id, p.domain FROM scope s JOIN projects p USING (organization_id)")
def j6_agency_projects(spark, sf_dir):
    return tenants.agency_projects(*_v(spark, sf_dir, "organizations", "projects")).select("agency_id", "organization_id", "id", "domain")


@query(f"""WITH {_SCOPE}, p AS (SELECT agency_id, count(*) AS projects, floor(avg(site_score) + 0.5)::BIGINT AS avg_site_score, count(*) FILTER (site_score >= 90) AS authority, count(*) FILTER (site_score BETWEEN 70 AND 89) AS extractable, count(*) FILTER (site_score BETWEEN 40 AND 69) AS readable, count(*) FILTER (site_score < 40) AS invisible FROM scope JOIN projects USING (organization_id) GROUP BY agency_id),
c AS (SELECT agency_id, count(*) - 1 AS clients, sum(crawl_credits_remaining)::BIGINT AS credits_remaining FROM scope JOIN organizations o ON o.id = organization_id GROUP BY agency_id)
SELECT c.agency_id, clients, credits_remaining, {', '.join(f'coalesce({x}, 0) AS {x}' for x in ('projects', 'avg_site_score', 'authority', 'extractable', 'readable', 'invisible'))} FROM c LEFT JOIN p USING (agency_id)""")
def a20_agency_summary(spark, sf_dir):
    return tenants.agency_summary(*_v(spark, sf_dir, "organizations", "projects"))


@query(f"WITH {_SCOPE} SELECT agency_id, id, domain, status, position::INTEGER AS position FROM (SELECT s.agency_id, j.id, p.domain, j.status, row_number() OVER (PARTITION BY s.agency_id ORDER BY j.created_at DESC, j.id DESC) AS position FROM scope s JOIN projects p USING (organization_id) JOIN crawl_jobs j ON j.project_id = p.id) WHERE position <= 10")
def w8_agency_crawls(spark, sf_dir):
    return tenants.agency_crawls(*_v(spark, sf_dir, "organizations", "projects", "crawl_jobs")).select("agency_id", "id", "domain", "status", "position")


@query(f"""WITH {_SCOPE} SELECT o.id, (SELECT count(*) FROM org_members m WHERE m.organization_id = o.id) AS members, (SELECT count(*) FROM projects p WHERE p.organization_id = o.id) AS projects,
coalesce((SELECT string_agg(domain || '=' || coalesce(site_score::VARCHAR, '-'), ',' ORDER BY domain) FROM projects p WHERE p.organization_id = o.id), '') AS scores FROM organizations o WHERE parent_org_id IS NOT NULL""")
def j17_agency_clients(spark, sf_dir):
    out = tenants.agency_clients(*_v(spark, sf_dir, "organizations", "projects", "org_members"))
    text = F.array_join(F.transform("scores", lambda s: F.concat(s["domain"], F.lit("="), F.coalesce(s["site_score"].cast("string"), F.lit("-")))), ",")
    return out.select("id", "members", "projects", F.coalesce(text, F.lit("")).alias("scores"))


@query(f"WITH {_TIERED}, {ctes('projects', 'organizations')} SELECT t.id, t.url, coalesce(p.name, '') AS project, coalesce(p.domain, '') AS domain, coalesce(o.name, '') AS organization FROM t LEFT JOIN projects p ON p.id = t.project_id LEFT JOIN organizations o ON o.id = p.organization_id")
def j5_listed_scans(spark, sf_dir):
    return tenants.listed_scans(_scans(spark, sf_dir), *_v(spark, sf_dir, "projects", "organizations")).select("id", "url", "project", "domain", "organization")


@query(f"WITH {ctes('users', 'org_members', 'organizations')} SELECT id, email FROM users u WHERE EXISTS (SELECT 1 FROM org_members m JOIN organizations o ON o.id = m.organization_id WHERE m.user_id = u.id AND o.plan_tier = 'agency')")
def j7_users_on_plan(spark, sf_dir):
    return tenants.users_on_plan(*_v(spark, sf_dir, "users", "org_members", "organizations"), "agency").select("id", "email")


@query(f"WITH {ctes('organizations', 'org_members', 'projects')} SELECT id, (SELECT count(*) FROM org_members m WHERE m.organization_id = o.id) AS members, (SELECT count(*) FROM projects p WHERE p.organization_id = o.id) AS projects FROM organizations o")
def j8_relation_counts(spark, sf_dir):
    orgs, members, projects = _v(spark, sf_dir, "organizations", "org_members", "projects")
    return tenants.with_counts(orgs.select("id"), members=(members, "organization_id"), projects=(projects, "organization_id"))


@query(f"WITH {ctes('org_members', 'projects')} SELECT p.id, p.domain FROM projects p WHERE p.organization_id IN (SELECT organization_id FROM org_members WHERE user_id = 1 AND role IN ('owner', 'admin'))")
def j15_visible_projects(spark, sf_dir):
    projects, members = _v(spark, sf_dir, "projects", "org_members")
    return tenants.visible_projects(projects, members, F.lit(1), ("owner", "admin")).select("id", "domain")


@query(f"WITH {ctes('organizations', 'org_members', 'projects')} SELECT o.id, m.role AS my_role, o.crawl_credits_remaining, (SELECT count(*) FROM org_members x WHERE x.organization_id = o.id) AS members, (SELECT count(*) FROM projects p WHERE p.organization_id = o.id) AS projects FROM organizations o JOIN org_members m ON m.organization_id = o.id WHERE m.user_id = 3")
def j16_my_organizations(spark, sf_dir):
    members, orgs, projects = _v(spark, sf_dir, "org_members", "organizations", "projects")
    return tenants.organizations_of(F.lit(3), members, orgs, projects).select("id", "my_role", "crawl_credits_remaining", "members", "projects")


@query(f"""WITH {ctes('projects', 'crawl_jobs', 'organizations')} SELECT p.id, p.schedule_freq, o.crawl_credits_remaining > 0 AS enqueued FROM projects p JOIN organizations o ON o.id = p.organization_id
WHERE schedule_freq IS NOT NULL AND (last_scheduled_at IS NULL OR last_scheduled_at < CASE schedule_freq WHEN 'daily' THEN TIMESTAMP '2024-01-30' WHEN 'weekly' THEN TIMESTAMP '2024-01-24' ELSE TIMESTAMP '2023-12-31' END)
AND NOT EXISTS (SELECT 1 FROM crawl_jobs j WHERE j.project_id = p.id AND j.status IN ('pending', 'running'))""")
def j4_due_projects(spark, sf_dir):
    return tenants.due_projects(*_v(spark, sf_dir, "projects", "crawl_jobs", "organizations"), _as_of()).select("id", "schedule_freq", "enqueued")


_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


@query(f"""WITH {_TIERED}, {ctes('projects', 'organizations')}, l AS (SELECT * FROM t)
SELECT l.id AS "ID", l.url AS "URL", l.score AS "Score", l.tier AS "Tier", '1' AS "Factor Version", coalesce(p.name, '') AS "Project", coalesce(p.domain, '') AS "Domain", coalesce(o.name, '') AS "Organization", {_ISO.format('l.created_at')} AS "Created At"
FROM l LEFT JOIN projects p ON p.id = l.project_id LEFT JOIN organizations o ON o.id = p.organization_id""")
def io8_scans_export(spark, sf_dir):
    return tenants.scans_export(_scans(spark, sf_dir).withColumn("factor_version", F.lit("1")), *_v(spark, sf_dir, "projects", "organizations"))


@query(f"""WITH {ctes('organizations', 'org_members', 'projects')} SELECT id AS "ID", name AS "Name", slug AS "Slug", plan_tier AS "Plan Tier", CASE WHEN stripe_subscription_id IS NULL THEN 'No' ELSE 'Yes' END AS "Has Subscription", (SELECT count(*) FROM org_members m WHERE m.organization_id = o.id) AS "Members",
(SELECT count(*) FROM projects p WHERE p.organization_id = o.id) AS "Projects", crawl_credits_remaining AS "Credits Remaining", crawl_credits_monthly AS "Credits Monthly", CASE WHEN parent_org_id IS NULL THEN 'No' ELSE 'Yes' END AS "Agency Child", {_ISO.format('created_at')} AS "Created At" FROM organizations o""")
def io9_organizations_export(spark, sf_dir):
    return tenants.organizations_export(*_v(spark, sf_dir, "organizations", "org_members", "projects"))


@query(f"""WITH {ctes('users', 'org_members', 'organizations')}, m AS (SELECT user_id, string_agg(o.name || ' (' || m.role || ')', '; ' ORDER BY o.id, o.name, m.role) AS orgs, arg_min(o.plan_tier, o.id) AS plan FROM org_members m JOIN organizations o ON o.id = m.organization_id GROUP BY user_id)
SELECT id AS "ID", email AS "Email", name AS "Name", role AS "Role", coalesce(orgs, '') AS "Organizations", coalesce(plan, '') AS "Plan Tier", {_ISO.format('created_at')} AS "Created At" FROM users LEFT JOIN m ON m.user_id = id""")
def io10_users_export(spark, sf_dir):
    return tenants.users_export(*_v(spark, sf_dir, "users", "org_members", "organizations"))


@query(f"""WITH {_ORGS} SELECT id, '"' || replace(name, '"', '""') || '",' || CASE WHEN stripe_subscription_id IS NULL THEN '' ELSE '"' || stripe_subscription_id || '"' END || ',"' || crawl_credits_monthly || '"' AS line FROM organizations""")
def io11_csv_lines(spark, sf_dir):
    return view(spark, sf_dir, "organizations").select("id", tenants.csv_line(F.col("name"), F.col("stripe_subscription_id"), F.col("crawl_credits_monthly")).alias("line"))


_CREDITS = """SELECT user_id AS org_id, ts, event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN 'scan' WHEN event_type = 'purchase' THEN 'crawl' WHEN event_type = 'signup' THEN 'invoice_paid' WHEN event_id % 5 = 0 THEN 'cancelled' ELSE 'plan_change' END AS kind,
  CAST(CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) % 20 WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 5000 WHEN 1 THEN 25000 ELSE 100000 END ELSE 0 END AS INT) AS amount FROM {events}"""


@query(f"""WITH e AS ({_CREDITS.format(events='events')}), m AS (SELECT *, coalesce(last_value(CASE kind WHEN 'plan_change' THEN amount WHEN 'cancelled' THEN 5 END IGNORE NULLS) OVER w, 5) AS monthly FROM e WINDOW w AS (PARTITION BY org_id ORDER BY ts, seq)),
r AS (SELECT *, max(CASE WHEN kind IN ('invoice_paid', 'cancelled') THEN seq END) OVER (PARTITION BY org_id) AS unused, (SELECT arg_max(seq, (ts, seq)) FROM m x WHERE x.org_id = m.org_id AND x.kind IN ('invoice_paid', 'cancelled')) AS last_reset FROM m)
SELECT org_id, arg_max(monthly, (ts, seq))::BIGINT AS monthly, (coalesce(max(monthly) FILTER (seq = last_reset), 5) - coalesce(sum(CASE kind WHEN 'scan' THEN 1 WHEN 'crawl' THEN amount ELSE 0 END) FILTER (last_reset IS NULL OR (ts, seq) > (SELECT (x.ts, x.seq) FROM m x WHERE x.seq = r.last_reset AND x.org_id = r.org_id)), 0))::BIGINT AS remaining FROM r GROUP BY org_id""")
def t4_credit_balance(spark, sf_dir):
    """The batch form of the credit stream."""
    out = tenants.credit_balances(spark.sql(_CREDITS.format(events=f"parquet.`{sf_dir}/events.parquet`")))
    return out.select("org_id", F.col("monthly").cast("long").alias("monthly"), F.col("remaining").cast("long").alias("remaining"))


_DELIVERIES = "SELECT user_id AS webhook_id, ts, event_id AS seq, event_type = 'purchase' AS ok FROM {events}"


@query(f"""WITH d AS ({_DELIVERIES.format(events='events')}), i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY webhook_id ORDER BY ts, seq) AS island FROM d), r AS (SELECT webhook_id, island, count(*) FILTER (NOT ok) AS failures FROM i GROUP BY ALL)
SELECT webhook_id, arg_max(failures, island) AS failure_count, max(failures) < 10 AS active FROM r GROUP BY webhook_id""")
def t5_webhook_breaker(spark, sf_dir):
    """The batch form of the delivery stream."""
    return tenants.breaker_states(spark.sql(_DELIVERIES.format(events=f"parquet.`{sf_dir}/events.parquet`")))


_BAD = r"""CASE WHEN host = '' THEN 'invalid' WHEN lower(regexp_extract(url, '^([A-Za-z]+):', 1)) NOT IN ('http', 'https') THEN 'scheme' WHEN regexp_matches(host, '^(localhost|127\.0\.0\.1|0\.0\.0\.0)$|^10\.|^192\.168\.|\.(local|internal)$') THEN 'private_host' END"""


@query(rf"""WITH {ctes('organizations')}, u AS (SELECT page_id % 40 AS request_id, page_id % 40 AS organization_id, page_id AS ord, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages),
r AS (SELECT u.*, o.plan_tier, o.crawl_credits_remaining AS left_, CASE o.plan_tier WHEN 'agency' THEN 100 WHEN 'enterprise' THEN 1000 END AS cap, {_BAD} AS bad, count(*) OVER (PARTITION BY request_id) AS n FROM u JOIN organizations o ON o.id = u.organization_id),
k AS (SELECT *, count(*) FILTER (bad IS NULL) OVER (PARTITION BY request_id ORDER BY ord) AS nth FROM r)
SELECT request_id, organization_id, ord, url, CASE WHEN cap IS NULL THEN 'plan' WHEN n > cap THEN 'too_many' WHEN bad IS NOT NULL THEN bad WHEN nth > left_ THEN 'no_credits' END AS reject_reason FROM k""")
def f6_bulk_requests(spark, sf_dir):
    """Each site's pages as one request of the organization with its number."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    urls = pages.select((F.col("page_id") % 40).alias("request_id"), (F.col("page_id") % 40).alias("organization_id"), F.col("page_id").alias("ord"), "url")
    return tenants.bulk_requests(urls, view(spark, sf_dir, "organizations"))
