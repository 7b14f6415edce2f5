"""Hand-made rows with results worked out from the rules."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagegauge.functions import exprs
from pagegauge.functions.constants import CITATION_WEIGHTS, LAYER_WEIGHTS, PLATFORMS, SUB_SCORE_WEIGHTS, SUB_SCORES
from pagegauge.operators import alerts, cache, entities, logs, scoring, sites, tenants


def _values(spark, column, rows, name="x", kind="double"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} {kind}")
    return [r["y"] for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_rounding_and_tiers(spark):
    assert _values(spark, exprs.js_round(F.col("x")), [-2.5, -0.5, 0.5, 2.4, 67.5]) == [-2, 0, 1, 2, 68]
    given = [95.0, 75.0, 50.0, 10.0, -5.0, 150.0, 89.5, 89.4, None]
    assert _values(spark, exprs.tier_of(F.col("x")), given) == ["authority", "extractable", "readable", "invisible", "invisible", "authority", "authority", "extractable", None]
    assert None not in _values(spark, exprs.tier_of(F.col("x")), [float(i) for i in range(101)])


def test_weights_sum_to_one():
    for weights in (SUB_SCORE_WEIGHTS, *LAYER_WEIGHTS.values(), *CITATION_WEIGHTS.values(), *({n: w for n, _, _, w, _ in s} for _, _, s in PLATFORMS)):
        assert sum(weights.values()) == pytest.approx(1)


def test_month_before_runs_over(spark):
    days = [dt.datetime(2024, 3, 31, 5), dt.datetime(2024, 5, 31), dt.datetime(2024, 1, 15)]
    assert _values(spark, exprs.month_before(F.col("x")), days, kind="timestamp_ntz") == [dt.datetime(2024, 3, 2, 5), dt.datetime(2024, 5, 1), dt.datetime(2023, 12, 15)]


def test_site_score(spark):
    pages = spark.createDataFrame([(1, 90, "homepage"), (1, 60, "page"), (1, 30, "page")], "project_id int, score int, page_type string")
    assert tuple(sites.site_scores(pages).first()) == (1, 68, "readable")
    assert tuple(sites.page_means(pages).first()) == (1, 60, 3)
    assert tuple(sites.tier_counts(pages).first()) == (1, 1, 0, 1, 1)


def test_delta(spark):
    cur = spark.createDataFrame([(1, "a", 70), (1, "b", 40), (1, "c", 10), (1, "d", 55)], "project_id int, url string, score int")
    old = spark.createDataFrame([(1, "a", 50), (1, "b", 70), (1, "d", 55), (1, "e", 5)], "project_id int, url string, score int")
    assert {r["url"]: (r["change"], r["delta"]) for r in sites.crawl_delta(cur, old).collect()} == {"a": ("improved", 20), "b": ("declined", -30), "c": ("new", None)}


def test_skips_by_latest_hash_only(spark):
    t = dt.datetime(2024, 1, 1)
    stored = spark.createDataFrame([(1, 1, "a", "x", t), (2, 1, "a", None, t + dt.timedelta(1)), (3, 1, "b", "y", t)], "id int, project_id int, url string, content_hash string, created_at timestamp_ntz")
    cur = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "c", "z"), (1, "b", None)], "project_id int, url string, content_hash string")
    assert sorted((r["url"], r["content_hash"]) for r in sites.changed_pages(cur, stored).collect() if r["content_hash"]) == [("a", "x"), ("c", "z")]
    assert sites.unchanged_pages(cur, stored).count() == 1


def test_fix_groups_take_the_first_text(spark):
    head = "x" * 50
    fixes = spark.createDataFrame([(1, "f", head + "one", "access", 5, 2), (1, "f", head + "two", "access", 4, 1)], "site int, factor_id string, description string, layer string, points int, ord int")
    row = sites.priority_fixes(fixes, "site", ("ord",)).first()
    assert (row["description"], row["avg_points"], row["affected_pages"], row["total_impact"]) == (head + "two", 5, 2, 9)


def _scan(score, faq=50, **more):
    return {c: more.get(c, 50) for c in SUB_SCORES} | {"score": score, "faq": faq}


def test_alerts(spark):
    def found(before, now):
        at = dt.datetime(2024, 1, 1)
        rows = [{"id": k, "project_id": 1, "url": "u", "created_at": at + dt.timedelta(k)} | s for k, s in enumerate((before, now)) if s]
        return sorted((r["type"], r["severity"], r["factor"]) for r in alerts.score_alerts(spark.createDataFrame(rows)).collect())

    assert found(_scan(80, 40), _scan(64, 10)) == [("factor_regression", "warning", "faq"), ("new_issue", "warning", "faq"), ("score_drop", "critical", None), ("tier_change", "critical", None)]
    assert found(None, _scan(64)) == []
    assert found(_scan(60), _scan(70)) == [("score_improvement", "info", None), ("tier_change", "info", None)]


def test_bot_access_and_authority(spark):
    status = {"browser": 200, "GPTBot": 403, "ClaudeBot": 404, "PerplexityBot": 200, "Googlebot": 200, "Bingbot": 200}
    probes = spark.createDataFrame([("u", a, s) for a, s in status.items()] + [("v", "browser", 0), ("v", "GPTBot", 0)], "url string, agent string, status int")
    got = {r["url"]: tuple(r)[1:] for r in scoring.bot_access(probes).collect()}
    assert got == {"u": (55, True, "GPTBot,ClaudeBot"), "v": (30, False, "GPTBot")}
    signals = spark.createDataFrame([("d", "kg", True, 60), ("d", "backlinks", True, 40), ("d", "wikidata", False, 0), ("e", "kg", False, 9)], "domain string, signal string, found boolean, score int")
    assert {r["domain"]: (r["authority"], r["n_signals"]) for r in scoring.domain_authority(signals).collect()} == {"d": (46, 2), "e": (0, 0)}


def test_fixes_are_ordered_and_numbered(spark):
    row = spark.range(1).select(*(F.lit(0).alias(c) for c in SUB_SCORES))
    facts = "is_https has_canonical has_primary_type has_breadcrumb hierarchy_valid has_faq_schema has_definition has_tldr has_sitemap has_rss has_llms_txt has_author has_fresh_date has_citations has_statistics".split()
    row = row.withColumns({f: F.lit(False) for f in facts}).withColumns({f: F.lit(0) for f in ("json_ld_count", "list_count", "word_count", "question_headings", "meta_description_length", "entity_density")}).withColumn("is_spa", F.lit(True))
    fixes = row.select(F.inline(scoring.fix_list())).collect()
    assert len(fixes) == 23 and [f["priority"] for f in fixes] == list(range(1, 24)) and [f["points"] for f in fixes] == sorted((f["points"] for f in fixes), reverse=True)


def test_log_lines(spark):
    line = '1.2.3.4 - - [{t}] "GET /p HTTP/1.1" 200 5 "-" "{a}"'
    t = "10/Oct/2000:13:55:36 +0000"
    rows = [line.format(t=t, a="GPTBot/1"), line.format(t=t, a="Googlebot-Image/1"), line.format(t=t, a="x ChatGPT-User y"), line.format(t=t, a="Firefox"), line.format(t="10/Oct/2000:23:55:36 -0700", a="ClaudeBot"), line.format(t="bad", a="CCBot"), "nonsense", ""]
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    got = {r["bot"]: r["ts"] for r in logs.visits(df, F.expr("TIMESTAMP '2024-01-31 00:00:00'")).select("bot", F.col("ts").cast("string").alias("ts")).collect()}
    assert got == {"GPTBot": "2000-10-10 13:55:36", "ChatGPT-User": "2000-10-10 13:55:36", "ClaudeBot": "2000-10-11 06:55:36", "CCBot": "2024-01-31 00:00:00"}


def test_histogram_leaves_out_100(spark):
    t = dt.datetime(2024, 1, 1)
    scans = spark.createDataFrame([(i, s, t) for i, s in enumerate((0, 9, 10, 99, 100))], "id int, score int, created_at timestamp_ntz")
    assert [r["n"] for r in tenants.score_histogram(scans).orderBy("bucket").collect()] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 1]


def test_bulk_import(spark):
    orgs = spark.createDataFrame([(1, "pro")], "id int, plan_tier string")
    projects = spark.createDataFrame([(k, 1, d) for k, d in enumerate(["old.com", *(f"p{i}.com" for i in range(6))])], "id int, organization_id int, domain string")
    batch = spark.createDataFrame([(1, k, r) for k, r in enumerate(("HTTPS://A.com/x", "a.com", "", "b.com"))], "organization_id int, input_ord int, raw string")
    got = [(r["domain"], r["outcome"], r["name"]) for r in tenants.imported(batch, projects, orgs).orderBy("input_ord").collect()]
    assert got == [("a.com", "created", "a"), ("a.com", "Already exists", None), (None, "Invalid domain", None), (None, "truncated", None)]


def test_due_projects(spark):
    as_of = dt.datetime(2024, 3, 31)
    rows = [(1, None, "daily"), (2, as_of - dt.timedelta(days=1), "daily"), (3, as_of - dt.timedelta(days=1, seconds=1), "daily"), (4, None, "daily"), (5, None, "weekly"), (6, dt.datetime(2024, 3, 1), "monthly"), (7, dt.datetime(2024, 3, 2), "monthly"), (8, None, None)]
    projects = spark.createDataFrame([(i, 2 if i == 5 else 1, f, t) for i, t, f in rows], "id int, organization_id int, schedule_freq string, last_scheduled_at timestamp_ntz")
    jobs = spark.createDataFrame([(4, "running"), (3, "completed")], "project_id int, status string")
    orgs = spark.createDataFrame([(1, 10), (2, 0)], "id int, crawl_credits_remaining int")
    due = tenants.due_projects(projects, jobs, orgs, F.lit(as_of).cast("timestamp_ntz"))
    assert {r["id"]: r["enqueued"] for r in due.collect()} == {1: True, 3: True, 5: False, 6: True}


def test_csv_cells(spark):
    df = spark.createDataFrame([('a"b', None, 1)], "a string, b string, c int")
    assert df.select(tenants.csv_line(F.col("a"), F.col("b"), F.col("c")).alias("l")).first()["l"] == '"a""b",,"1"'


def test_write_csv(spark, tmp_path):
    tenants.write_csv(spark.createDataFrame([('a"b', None)], "x string, `y z` string").coalesce(1), f"{tmp_path}/out")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()] == ['"x","y z"', '"a""b",']


CREDITS = [(1, 1, "plan_change", 5000), (1, 2, "invoice_paid", 0), (1, 3, "scan", 0), (1, 4, "crawl", 30), (1, 5, "invoice_paid", 0), (1, 6, "scan", 0), (2, 1, "scan", 0), (3, 1, "plan_change", 99), (3, 2, "cancelled", 0), (3, 3, "crawl", 7)]
DELIVERIES = [(1, k, k == 9) for k in range(19)] + [(2, k, False) for k in range(10)] + [(2, 10, True), (3, 0, True)]


def _at(rows, schema, spark):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(key, base + dt.timedelta(seconds=seq), seq, *rest) for key, seq, *rest in rows], schema)


def test_credit_balances(spark):
    got = {r["org_id"]: (r["monthly"], r["remaining"]) for r in tenants.credit_balances(_at(CREDITS, "org_id long, ts timestamp_ntz, seq long, kind string, amount int", spark)).collect()}
    assert got == {1: (5000, 4999), 2: (5, 4), 3: (5, -2)}


def test_breaker(spark):
    got = {r["webhook_id"]: (r["failure_count"], r["active"]) for r in tenants.breaker_states(_at(DELIVERIES, "webhook_id long, ts timestamp_ntz, seq long, ok boolean", spark)).collect()}
    assert got == {1: (9, True), 2: (0, False), 3: (0, True)}


def test_fan_out(spark):
    events = spark.createDataFrame([(1, "score_drop", "m"), (1, "other", "m"), (2, "score_drop", "m")], "organization_id int, type string, message string")
    hooks = spark.createDataFrame([(10, 1, "u", True, ["score_drop"]), (11, 1, "u", False, ["score_drop"]), (12, 1, "u", True, ["other", "score_drop"])], "id int, organization_id int, url string, active boolean, events array<string>")
    got = sorted((r["webhook_id"], r["type"]) for r in alerts.fan_out(events, hooks).collect())
    assert got == [(10, "score_drop"), (12, "other"), (12, "score_drop")]


def test_entities(spark):
    pages = spark.createDataFrame([("s", "1", ["Acme Inc"], ["A"], ["a", "b"]), ("s", "2", ["ACME, Inc.", "Acme"], ["A"], ["b", "c"]), ("s", "3", [], [], []), ("t", "1", ["X"], [], ["q"])], "site string, url string, organization_names array<string>, author_names array<string>, top_entities array<string>")
    assert {r["site"]: r["overlap"] for r in entities.entity_overlap(pages).collect()} == {"s": 11, "t": 50}
    names = entities.name_variants(pages, "organization_names")
    assert sorted(r["name"] for r in names.collect()) == ["ACME, Inc.", "Acme", "Acme Inc"]
    assert sorted(r["url"] for r in entities.affected_pages(pages, names, "organization_names").collect()) == ["1", "2"]
    got = {r["site"]: tuple(r)[2:] for r in entities.site_consistency(pages).collect()}
    assert got == {"s": (40, 100, 11, 48), "t": (100, 100, 100, 100)}


def test_cache_expiry(spark):
    as_of = dt.datetime(2024, 1, 31)
    stored = spark.createDataFrame([("A.com ", 10, as_of - dt.timedelta(30)), ("b.com", 20, as_of - dt.timedelta(31))], "domain string, authority int, fetched_at timestamp_ntz")
    asked = spark.createDataFrame([(" a.com",), ("b.com",), ("c.com",)], "domain string")
    got = {r["domain"]: (r["authority"], r["refresh"]) for r in cache.cached_authority(asked, stored, F.lit(as_of).cast("timestamp_ntz")).collect()}
    assert got == {"a.com": (10, False), "b.com": (None, True), "c.com": (None, True)}
