"""Tenants, plans, credits, listings and exports.

Dimensions (organizations, projects, plans) are joined to facts with plain equi-joins; Spark broadcasts the small ones by
their measured size. ``as_of`` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import PLAN_DOMAINS, PLAN_PRICES, TIERS
from ..functions.exprs import js_round, month_before, percent
from . import heavy


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v)))[key]


def contains_text(column: str, text: str) -> Column:
    """Case-insensitive containment; nulls do not match."""
    return F.coalesce(F.contains(F.lower(column), F.lower(F.lit(text))), F.lit(False))


def filtered_scans(scans: DataFrame, search: str | None = None, tier: str | None = None) -> DataFrame:
    """F7."""
    out = scans.where(contains_text("url", search)) if search else scans
    return out.where(F.col("tier") == tier) if tier else out


def filtered_organizations(orgs: DataFrame, search: str | None = None, plan: str | None = None, subscribed: bool | None = None) -> DataFrame:
    """F8: name or slug holds a text; plan; with or without a subscription."""
    out = orgs.where(contains_text("name", search) | contains_text("slug", search)) if search else orgs
    out = out.where(F.col("plan_tier") == plan) if plan else out
    if subscribed is None:
        return out
    return out.where(F.col("stripe_subscription_id").isNotNull() if subscribed else F.col("stripe_subscription_id").isNull())


def expiring(orgs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """subscriptions that end within the next days, soonest first."""
    ends = F.col("current_period_end")
    return orgs.where(F.col("stripe_subscription_id").isNotNull() & (ends >= as_of) & (ends <= F.timestamp_add("DAY", F.lit(days), as_of))).orderBy("current_period_end", "id")


def normal_domain(raw: Column) -> Column:
    """trimmed, lower case, without scheme and path; shorter than three signs is null."""
    domain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), "^https?://", ""), "/.*$", "")
    return F.when(F.length(domain) >= 3, domain)


def default_name(domain: Column) -> Column:
    """the domain without its last label, other signs than letters and digits as blanks."""
    return F.regexp_replace(F.regexp_replace(domain, r"\.[^.]+$", ""), "[^A-Za-z0-9]", " ")


def page_of(rows: DataFrame, sort: str | None, allowed: tuple[str, ...], page: int = 1, limit: int = 20, descending: bool = True, tie: str = "id") -> DataFrame:
    """L1: one page of a listing; sorted by an allowed column, else by creation time, newest first; ties by id."""
    page, limit = max(1, page), min(100, max(1, limit))
    by = F.col(sort) if sort in allowed else F.col("created_at")
    down = descending if sort in allowed else True
    return rows.orderBy(by.desc_nulls_last() if down else by.asc_nulls_last(), tie).offset((page - 1) * limit).limit(limit)


def page_meta(rows: DataFrame, limit: int = 20) -> DataFrame:
    """L1: rows and pages of a listing."""
    limit = min(100, max(1, limit))
    return rows.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / limit))


def revenue_by_plan(orgs: DataFrame) -> DataFrame:
    """Organizations and monthly revenue of each plan; an unknown plan is free of charge."""
    price = F.coalesce(_lookup(PLAN_PRICES, F.col("plan_tier")), F.lit(0))
    return orgs.groupBy("plan_tier").agg(F.count("*").alias("n_orgs")).withColumn("revenue", F.col("n_orgs") * price)


def recurring_revenue(orgs: DataFrame) -> DataFrame:
    """Monthly and yearly recurring revenue."""
    return revenue_by_plan(orgs).agg(F.sum("revenue").alias("mrr")).withColumn("arr", F.col("mrr") * 12)


def conversion(orgs: DataFrame) -> DataFrame:
    """Share of organizations that do not pay ("churn") and that do."""
    paid = F.count_if(F.col("stripe_subscription_id").isNotNull())
    counts = orgs.agg(F.count("*").alias("total"), paid.alias("paid"))
    return counts.select("total", "paid", percent(F.col("total") - F.col("paid"), F.col("total")).alias("churn"), percent(F.col("paid"), F.col("total")).alias("conversion"))


def credit_totals(orgs: DataFrame) -> DataFrame:
    """A13."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    monthly, left = total("crawl_credits_monthly"), total("crawl_credits_remaining")
    return orgs.agg(monthly.alias("monthly"), left.alias("remaining"), (monthly - left).alias("used"))


def scan_statistics(scans: DataFrame) -> DataFrame:
    """By tier."""
    return scans.groupBy("tier").agg(js_round(F.avg("score")).alias("avg_score"), F.count("*").alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def newest(scans: DataFrame, limit: int | None) -> DataFrame:
    """The newest ``limit`` scans, or all."""
    return scans if limit is None else scans.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def score_histogram(scans: DataFrame, limit: int | None = None) -> DataFrame:
    """Ten buckets of all scans, or of the newest ``limit``; empty ones as 0; a score of 100 is in none."""
    buckets = scans.sparkSession.range(10).select(F.col("id").cast("int").alias("bucket"))
    counts = newest(scans, limit).where("score between 0 and 99").groupBy(F.floor(F.col("score") / 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    return buckets.join(counts, "bucket", "left").select("bucket", F.concat((F.col("bucket") * 10).cast("string"), F.lit("-"), (F.col("bucket") * 10 + 9).cast("string")).alias("range"), F.coalesce("n", F.lit(0)).alias("n"))


def most_scanned(scans: DataFrame, top: int = 10, tracked: int = heavy.TRACKED) -> DataFrame:
    """From the scans of the urls that can be among the first, where a summary tells them, else from all."""
    near = heavy.candidates(scans.select("url"), "url", top, tracked)
    return (scans if near is None else near).groupBy("url").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "url").limit(top)


def daily_counts(rows: DataFrame, as_of: Column, days: int = 30, at: str = "created_at") -> DataFrame:
    """Rows of each of the last days, both ends, days without any as 0."""
    last = F.to_date(as_of)
    calendar = rows.sparkSession.range(1).select(F.explode(F.sequence(F.date_add(last, -days), last)).alias("day"))
    counts = rows.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def job_counts(jobs: DataFrame) -> DataFrame:
    """Jobs by status; pending and running ones are the queue."""
    of = lambda s: F.count_if(F.col("status") == s)
    return jobs.agg(of("pending").alias("pending"), of("running").alias("running"), of("completed").alias("completed"), of("failed").alias("failed"), (of("pending") + of("running")).alias("queue_depth"))


def platform_totals(users: DataFrame, orgs: DataFrame, scans: DataFrame) -> DataFrame:
    """Single rows side by side."""
    out = users.agg(F.count("*").alias("users"))
    for rows in (orgs.agg(F.count("*").alias("organizations"), F.count("stripe_subscription_id").alias("paid")), scans.agg(F.count("*").alias("scans"))):
        out = out.crossJoin(F.broadcast(rows))
    return out


def with_counts(parents: DataFrame, **children: tuple[DataFrame, str]) -> DataFrame:
    """The number of rows of each child table (name: (table, its key of the parent)), 0 when none."""
    out = parents
    for name, (child, key) in children.items():
        out = out.join(child.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name)), "id", "left")
    return out.withColumns({name: F.coalesce(name, F.lit(0)) for name in children})


def agency_scope(orgs: DataFrame) -> DataFrame:
    """Each agency with its own and its client organizations."""
    agencies = orgs.where(F.col("plan_tier").isin("agency", "enterprise")).select(F.col("id").alias("agency_id"))
    clients = orgs.where("parent_org_id is not null").select(F.col("parent_org_id").alias("agency_id"), F.col("id").alias("organization_id"))
    return agencies.select("agency_id", F.col("agency_id").alias("organization_id")).unionByName(clients.join(agencies, "agency_id"))


def agency_projects(orgs: DataFrame, projects: DataFrame) -> DataFrame:
    return agency_scope(orgs).join(projects, "organization_id")


def agency_summary(orgs: DataFrame, projects: DataFrame) -> DataFrame:
    """Projects, clients, mean score and tier bands of the scored projects, credits left, of each agency's scope."""
    scope = agency_scope(orgs)
    score, above = F.col("site_score"), 1_000
    bands = []
    for name, least in TIERS:
        bands.append(F.count_if((score < above) & ((score >= least) if name != TIERS[-1][0] else F.lit(True))).alias(name))
        above = least
    per = scope.join(projects, "organization_id").groupBy("agency_id").agg(F.count("*").alias("projects"), js_round(F.avg("site_score")).alias("avg_site_score"), *bands)
    credits = scope.join(orgs.select(F.col("id").alias("organization_id"), "crawl_credits_remaining"), "organization_id").groupBy("agency_id").agg((F.count("*") - 1).alias("clients"), F.sum("crawl_credits_remaining").alias("credits_remaining"))
    return credits.join(per, "agency_id", "left").na.fill(0)


def agency_crawls(orgs: DataFrame, projects: DataFrame, jobs: DataFrame, limit: int = 10) -> DataFrame:
    """The newest crawl jobs of each agency's scope, with their domains."""
    scoped = agency_projects(orgs, projects).select("agency_id", F.col("id").alias("project_id"), "domain")
    order = Window.partitionBy("agency_id").orderBy(F.desc("created_at"), F.desc("id"))
    return scoped.join(jobs, "project_id").withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def agency_clients(orgs: DataFrame, projects: DataFrame, members: DataFrame) -> DataFrame:
    """Child organizations with their counts and the scores of their projects."""
    scores = projects.groupBy(F.col("organization_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("domain", "site_score"))).alias("scores"))
    return with_counts(orgs.where("parent_org_id is not null"), members=(members, "organization_id"), projects=(projects, "organization_id")).join(scores, "id", "left")


def listed_scans(scans: DataFrame, projects: DataFrame, orgs: DataFrame) -> DataFrame:
    """Scans with the names of their project and organization, empty where there is none."""
    project = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"), "domain", "organization_id")
    org = orgs.select(F.col("id").alias("organization_id"), F.col("name").alias("organization"))
    out = scans.join(project, "project_id", "left").join(org, "organization_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("project", "domain", "organization")})


def users_on_plan(users: DataFrame, members: DataFrame, orgs: DataFrame, plan: str) -> DataFrame:
    """Users that belong to some organization of a plan."""
    on = members.join(orgs.where(F.col("plan_tier") == plan).select(F.col("id").alias("organization_id")), "organization_id", "left_semi")
    return users.join(on.select(F.col("user_id").alias("id")), "id", "left_semi")


def visible_projects(projects: DataFrame, members: DataFrame, user: Column, roles: tuple[str, ...] | None = None) -> DataFrame:
    """Projects of organizations that a user belongs to, in one of the roles if they are given."""
    mine = members.where(F.col("user_id") == user)
    mine = mine.where(F.col("role").isin(*roles)) if roles else mine
    return projects.join(mine, "organization_id", "left_semi")


def organizations_of(user: Column, members: DataFrame, orgs: DataFrame, projects: DataFrame) -> DataFrame:
    """A user's organizations with role, credits and counts."""
    mine = members.where(F.col("user_id") == user).select(F.col("organization_id").alias("id"), F.col("role").alias("my_role"))
    return with_counts(orgs.join(mine, "id"), members=(members, "organization_id"), projects=(projects, "organization_id"))


def due_projects(projects: DataFrame, jobs: DataFrame, orgs: DataFrame, as_of: Column) -> DataFrame:
    """Projects due for a scheduled crawl; ``enqueued`` where their organization has credits.

    "Older" is strict. A month before is a calendar month, whose missing days run over.
    """
    active = jobs.where(F.col("status").isin("pending", "running")).select(F.col("project_id").alias("id"))
    last, freq = F.col("last_scheduled_at"), F.col("schedule_freq")
    cut = F.when(freq == "daily", F.timestamp_add("DAY", F.lit(-1), as_of)).when(freq == "weekly", F.timestamp_add("DAY", F.lit(-7), as_of)).when(freq == "monthly", month_before(as_of))
    due = projects.where(freq.isNotNull() & (last.isNull() | (last < cut))).join(active, "id", "left_anti")
    credits = orgs.select(F.col("id").alias("organization_id"), "crawl_credits_remaining")
    return due.join(credits, "organization_id").withColumn("enqueued", F.col("crawl_credits_remaining") > 0)


def within_slots(batch: DataFrame, projects: DataFrame, orgs: DataFrame) -> DataFrame:
    """The rows of each organization's batch (organization_id, input_ord, ...) that its plan has room for, before they are looked at.

    ``slots`` is null where the plan has no limit.
    """
    limit = _lookup({k: -1 if v is None else v for k, v in PLAN_DOMAINS.items()}, F.col("plan_tier"))
    room = with_counts(orgs.select("id", "plan_tier"), existing=(projects, "organization_id"))
    room = room.select(F.col("id").alias("organization_id"), F.when(limit >= 0, F.greatest(F.lit(0), limit - F.col("existing"))).alias("slots"))
    place = F.row_number().over(Window.partitionBy("organization_id").orderBy("input_ord"))
    return batch.withColumn("place", place).join(room, "organization_id").withColumn("fits", F.col("slots").isNull() | (F.col("place") <= F.col("slots")))


def imported(batch: DataFrame, projects: DataFrame, orgs: DataFrame) -> DataFrame:
    """Each row of a batch with its domain, name and outcome: created, Invalid domain, Already exists or truncated."""
    rows = within_slots(batch, projects, orgs).withColumn("domain", F.when(F.col("fits"), normal_domain(F.col("raw"))))
    known = projects.select("organization_id", "domain").distinct().withColumn("known", F.lit(True))
    rows = rows.join(known, ["organization_id", "domain"], "left")
    nth = F.row_number().over(Window.partitionBy("organization_id", "domain").orderBy("input_ord"))
    outcome = F.when(~F.col("fits"), "truncated").when(F.col("domain").isNull(), "Invalid domain").when(F.col("known") | (F.col("nth") > 1), "Already exists").otherwise("created")
    rows = rows.withColumn("nth", F.when(F.col("domain").isNotNull(), nth)).withColumn("outcome", outcome)
    return rows.withColumn("name", F.when(F.col("outcome") == "created", default_name(F.col("domain")))).drop("known", "nth", "slots", "place", "fits")


def csv_line(*columns: Column) -> Column:
    """IO11: every cell quoted, quotes doubled; a null cell is empty and without quotes."""
    cell = lambda c: F.when(c.isNull(), "").otherwise(F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"')))
    return F.concat_ws(",", *(cell(c) for c in columns))


def iso_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def scans_export(scans: DataFrame, projects: DataFrame, orgs: DataFrame, limit: int | None = None) -> DataFrame:
    """IO8: all scans, or the newest ``limit``, as labelled cells."""
    rows = listed_scans(newest(scans, limit), projects, orgs)
    return rows.select(F.col("id").alias("ID"), F.col("url").alias("URL"), F.col("score").alias("Score"), F.col("tier").alias("Tier"), F.col("factor_version").alias("Factor Version"), F.col("project").alias("Project"), F.col("domain").alias("Domain"), F.col("organization").alias("Organization"), iso_time(F.col("created_at")).alias("Created At"))


def organizations_export(orgs: DataFrame, members: DataFrame, projects: DataFrame) -> DataFrame:
    """IO9."""
    yes = lambda c: F.when(F.col(c).isNotNull(), "Yes").otherwise("No")
    rows = with_counts(orgs, members=(members, "organization_id"), projects=(projects, "organization_id"))
    return rows.select(
        F.col("id").alias("ID"), F.col("name").alias("Name"), F.col("slug").alias("Slug"), F.col("plan_tier").alias("Plan Tier"), yes("stripe_subscription_id").alias("Has Subscription"), F.col("members").alias("Members"), F.col("projects").alias("Projects"),
        F.col("crawl_credits_remaining").alias("Credits Remaining"), F.col("crawl_credits_monthly").alias("Credits Monthly"), yes("parent_org_id").alias("Agency Child"), iso_time(F.col("created_at")).alias("Created At"),
    )


def users_export(users: DataFrame, members: DataFrame, orgs: DataFrame) -> DataFrame:
    """IO10: memberships as "Organization (role); ..."; the plan of the first; in order of organization id."""
    org = orgs.select(F.col("id").alias("organization_id"), F.col("name").alias("org_name"), "plan_tier")
    joined = members.select("user_id", "organization_id", F.col("role").alias("member_role")).join(org, "organization_id")
    texts = joined.groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("organization_id", "org_name", "member_role", "plan_tier"))).alias("m"))
    rows = users.join(texts, "id", "left")
    names = F.array_join(F.transform("m", lambda x: F.concat(x["org_name"], F.lit(" ("), x["member_role"], F.lit(")"))), "; ")
    return rows.select(F.col("id").alias("ID"), F.col("email").alias("Email"), F.coalesce("name", F.lit("")).alias("Name"), F.col("role").alias("Role"), F.coalesce(names, F.lit("")).alias("Organizations"), F.coalesce(F.get("m", F.lit(0))["plan_tier"], F.lit("")).alias("Plan Tier"), iso_time(F.col("created_at")).alias("Created At"))


def write_csv(rows: DataFrame, path: str) -> None:
    """A labelled table as CSV text by the cell rule, a header in each file."""
    head = ",".join('"' + c.replace('"', '""') + '"' for c in rows.columns)
    rows.select(csv_line(*(F.col(f"`{c}`") for c in rows.columns)).alias(head)).write.option("quote", "").option("header", True).option("delimiter", "\u0001").csv(path)


def credit_balances(events: DataFrame, as_monthly: str = "monthly") -> DataFrame:
    """T4, batch form: (org_id, ts, seq, kind, amount) folded into monthly and remaining credits.

    An invoice sets the remaining credits to the monthly ones, a cancellation both to 5; a change of plan sets the monthly ones;
    scans and crawls take credits off. The last reset counts, and what is taken after it.
    """
    order = F.struct("ts", "seq")
    past = Window.partitionBy("org_id").orderBy("ts", "seq")
    monthly = F.last(F.when(F.col("kind") == "plan_change", F.col("amount")).when(F.col("kind") == "cancelled", F.lit(5)), ignorenulls=True).over(past)
    rows = events.withColumn(as_monthly, F.coalesce(monthly, F.lit(5)))
    reset = F.when(F.col("kind").isin("invoice_paid", "cancelled"), F.col(as_monthly))
    resets = F.last(reset, ignorenulls=True).over(past)
    spell = F.sum(F.when(reset.isNotNull(), 1).otherwise(0)).over(past)
    used = F.when(F.col("kind") == "scan", 1).when(F.col("kind") == "crawl", F.col("amount")).otherwise(0)
    rows = rows.withColumns({"reset": F.coalesce(resets, F.lit(5)), "spell": spell, "used": used})
    per = rows.groupBy("org_id", "spell").agg(F.max_by(as_monthly, order).alias(as_monthly), F.max_by("reset", order).alias("reset"), F.sum("used").alias("used"))
    last = per.groupBy("org_id").agg(F.max_by(F.struct(as_monthly, (F.col("reset") - F.col("used")).alias("remaining")), "spell").alias("x"))
    return last.select("org_id", "x.*")


def breaker_states(deliveries: DataFrame, limit: int = 10) -> DataFrame:
    """T5, batch form: (webhook_id, ts, seq, ok) to the current failure run and whether the webhook is still active.

    A webhook that once had ``limit`` failures in a row is disabled for good.
    """
    order = Window.partitionBy("webhook_id").orderBy("ts", "seq")
    rows = deliveries.withColumn("island", F.sum(F.col("ok").cast("int")).over(order))
    runs = rows.groupBy("webhook_id", "island").agg(F.count_if(~F.col("ok")).alias("failures"))
    out = runs.groupBy("webhook_id").agg(F.max_by("failures", "island").alias("failure_count"), F.max("failures").alias("longest"))
    return out.select("webhook_id", "failure_count", (F.col("longest") < limit).alias("active"))


def bulk_requests(urls: DataFrame, orgs: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """urls of requests (request_id, organization_id, ord, url) with a reject reason: plan, request too large, bad url, no credits.

    Valid urls of a request take one credit each, in order.
    """
    from .urls import url_reject_reason

    caps = caps or {"agency": 100, "enterprise": 1_000}
    org = orgs.select(F.col("id").alias("organization_id"), "plan_tier", "crawl_credits_remaining")
    rows = urls.join(org, "organization_id").withColumn("n", F.count("*").over(Window.partitionBy("request_id")))
    cap = _lookup(caps, F.col("plan_tier"))
    rows = rows.withColumn("bad", url_reject_reason(F.col("url")))
    nth = F.count(F.when(F.col("bad").isNull(), 1)).over(Window.partitionBy("request_id").orderBy("ord"))
    reason = F.when(cap.isNull(), "plan").when(F.col("n") > cap, "too_many").when(F.col("bad").isNotNull(), F.col("bad")).when(nth > F.col("crawl_credits_remaining"), "no_credits")
    return rows.withColumn("reject_reason", reason).drop("bad", "n", "plan_tier", "crawl_credits_remaining")
