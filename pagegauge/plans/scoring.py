"""Queries over sub-scores, probes, authority signals and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import CITATION_REASONS, CITATION_WEIGHTS, FIXES, LAYER_WEIGHTS, PLATFORMS, STRENGTHS, SUB_SCORE_WEIGHTS, SUB_SCORES, TIER_ORDER, WEAKNESSES
from ..functions.exprs import tier_of
from ..operators import alerts, scoring
from ..sources.bridge import ctes, view
from .registry import query

_SCANS = ctes("scans")


def _sum(weights: dict[str, float]) -> str:
    return f"floor({' + '.join(f'{c}::DOUBLE * {w}::DOUBLE' for c, w in weights.items())} + 0.5)::BIGINT"


def _tier(x: str) -> str:
    return f"CASE WHEN {x} >= 90 THEN 'authority' WHEN {x} >= 70 THEN 'extractable' WHEN {x} >= 40 THEN 'readable' ELSE 'invisible' END"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("SELECT o_orderkey AS id, floor(o_totalprice / 3000 + 0.5)::BIGINT AS rounded, CASE WHEN floor(o_totalprice / 3000 + 0.5) >= 90 THEN 'authority' WHEN floor(o_totalprice / 3000 + 0.5) >= 70 THEN 'extractable' WHEN floor(o_totalprice / 3000 + 0.5) >= 40 THEN 'readable' ELSE 'invisible' END AS tier FROM orders")
def f5_tier(spark, sf_dir):
    score = F.col("o_totalprice") / 3000
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.floor(score + 0.5).alias("rounded"), tier_of(score).alias("tier"))


@query(f"WITH {_SCANS} SELECT id, page_score, {_tier('page_score')} AS page_tier FROM (SELECT id, {_sum(SUB_SCORE_WEIGHTS)} AS page_score FROM scans)")
def p15_page_score(spark, sf_dir):
    return scoring.with_scores(view(spark, sf_dir, "scans")).select("id", "page_score", "page_tier")


@query(f"WITH {_SCANS} SELECT id, {', '.join(f'{_sum(w)} AS {layer}' for layer, w in LAYER_WEIGHTS.items())} FROM scans")
def p16_layer_scores(spark, sf_dir):
    return view(spark, sf_dir, "scans").select("id", scoring.layer_scores().alias("layers")).select("id", "layers.*")


# facts that the made-up scans lack, by id
_FACTS = {
    "is_https": "id % 2 = 0", "has_canonical": "id % 3 = 0", "is_spa": "id % 7 = 0", "json_ld_count": "id % 4", "has_primary_type": "id % 5 = 0", "has_breadcrumb": "id % 6 = 0",
    "hierarchy_valid": "id % 2 = 1", "list_count": "id % 3", "word_count": "(id * 7) % 900", "has_faq_schema": "id % 9 = 0", "question_headings": "id % 4", "meta_description_length": "id % 5",
    "has_definition": "id % 3 = 1", "has_tldr": "id % 8 = 0", "has_sitemap": "id % 2 = 0", "has_rss": "id % 5 = 1", "has_llms_txt": "id % 11 = 0", "entity_density": "id % 3", "has_citations": "id % 4 = 2", "has_statistics": "id % 6 = 3",
}
_FACT_SQL = ", ".join(f"({x}) AS {name}" for name, x in _FACTS.items())


def _facts(spark, sf_dir):
    return view(spark, sf_dir, "scans").withColumns({name: F.expr(x) for name, x in _FACTS.items()})


_FIX_ROWS = " UNION ALL ".join(f"SELECT id, {k} AS k, {points}::BIGINT AS points, '{layer}' AS layer, '{factor}' AS factor_id, {_q(text)} AS description FROM f WHERE {sub} < {gate} AND ({condition})" for k, (sub, gate, condition, points, layer, factor, text) in enumerate(FIXES))


@query(f"WITH {_SCANS}, f AS (SELECT *, {_FACT_SQL} FROM scans) SELECT id, points, layer, factor_id, description, row_number() OVER (PARTITION BY id ORDER BY points DESC, k)::INTEGER AS priority FROM ({_FIX_ROWS})")
def p17_fixes(spark, sf_dir):
    out = _facts(spark, sf_dir).select("id", F.inline(scoring.fix_list()))
    return out.select("id", F.col("points").cast("long").alias("points"), "layer", "factor_id", "description", "priority")


_CITE = " UNION ALL ".join(f"SELECT id, {_q(name)} AS platform, {k} AS k, {_sum(w)} AS score FROM scans" for k, (name, w) in enumerate(CITATION_WEIGHTS.items()))
_REASON = " ".join(f"WHEN platform = {_q(n)} THEN CASE WHEN score >= 70 THEN {_q(a)} WHEN score >= 40 THEN {_q(b)} ELSE {_q(c)} END" for n, (a, b, c) in CITATION_REASONS.items())


@query(f"WITH {_SCANS}, p AS ({_CITE}) SELECT id, platform, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS confidence, CASE {_REASON} END AS reasoning FROM p")
def p18_citation_platforms(spark, sf_dir):
    sim = view(spark, sf_dir, "scans").select("id", scoring.citation_simulation().alias("c"))
    return sim.select("id", F.inline("c.platforms")).withColumnRenamed("name", "platform")


def _texts(rules) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {c} THEN {_q(t)} END" for c, t in rules) + ")"


@query(f"WITH {_SCANS}, p AS ({_CITE}), o AS (SELECT id, floor(sum(score)::DOUBLE / 6 + 0.5)::BIGINT AS overall FROM p GROUP BY id) SELECT o.id, overall, {_texts(STRENGTHS)} AS strengths, {_texts(WEAKNESSES)} AS weaknesses FROM o JOIN scans s ON s.id = o.id")
def p18_citation_summary(spark, sf_dir):
    sim = view(spark, sf_dir, "scans").select("id", scoring.citation_simulation().alias("c"))
    return sim.select("id", "c.overall", F.array_join("c.strengths", "; ").alias("strengths"), F.array_join("c.weaknesses", "; ").alias("weaknesses"))


def _ready(spark, sf_dir):
    return view(spark, sf_dir, "scans").select("id", *SUB_SCORES, F.when(F.col("has_fresh_date"), 1).otherwise(0).alias("is_fresh"), (F.col("id") % 80).alias("authority"))


_SIGNALS = " UNION ALL ".join(f"SELECT id, '{key}' AS platform, {k} AS k, {_q(name)} AS name, {j} AS j, {_q(signal)} AS signal, {_q(text)} AS text, {weight}::DOUBLE AS w, {column} >= {least} AS present FROM r" for k, (key, name, signals) in enumerate(PLATFORMS) for j, (signal, column, least, weight, text) in enumerate(signals))
_READY = f"""{_SCANS}, r AS (SELECT id, {', '.join(SUB_SCORES)}, CASE WHEN has_fresh_date THEN 1 ELSE 0 END AS is_fresh, id % 80 AS authority FROM scans), g AS ({_SIGNALS}),
s AS (SELECT id, platform, k, name, floor(sum(CASE WHEN present THEN w * 100 ELSE 0 END ORDER BY j) + 0.5)::BIGINT AS score FROM g GROUP BY ALL)"""


@query(f"WITH {_READY} SELECT id, platform, score, CASE WHEN score > 60 THEN 'high' WHEN score > 30 THEN 'medium' ELSE 'low' END AS confidence FROM s")
def p19_platform_readiness(spark, sf_dir):
    return _ready(spark, sf_dir).select("id", F.inline(scoring.platform_readiness(advise=False))).select("id", "platform", "score", "confidence")


@query(f"WITH {_READY} SELECT id, floor(sum(score)::DOUBLE / 6 + 0.5)::BIGINT AS overall, arg_max(platform, score * 10 - k) AS strongest, arg_min(platform, score * 10 - k) AS weakest FROM s GROUP BY id")
def w7_platform_extremes(spark, sf_dir):
    return _ready(spark, sf_dir).select("id", scoring.extremes(scoring.platform_readiness(advise=False)).alias("x")).select("id", "x.*")


@query(f"""WITH {_READY}, m AS (SELECT *, row_number() OVER (PARTITION BY id, platform ORDER BY w DESC, j) AS n FROM g WHERE NOT present)
SELECT id, platform, string_agg('Improve ' || lower(signal) || ' for +' || floor(w * 100 + 0.5)::INTEGER || ' points on ' || name || ': ' || text, ' | ' ORDER BY n) AS recommendations FROM m WHERE n <= 3 GROUP BY id, platform""")
def l3_recommendations(spark, sf_dir):
    out = _ready(spark, sf_dir).select("id", F.inline(scoring.platform_readiness())).where(F.size("recommendations") > 0)
    return out.select("id", "platform", F.array_join("recommendations", " | ").alias("recommendations"))


_BOTS = (("GPTBot", 20), ("ClaudeBot", 20), ("PerplexityBot", 15), ("Googlebot", 25), ("Bingbot", 15))


@query(f"""WITH {ctes('probe_results')}, b AS (SELECT url, status BETWEEN 200 AND 399 AS fine FROM probe_results WHERE agent = 'browser'),
x AS (SELECT p.url, p.agent, p.status IN (403, 406) AS waf, p.status IN (0, 403, 406, 429, 451) OR (b.fine AND p.status >= 400) AS blocked, b.fine FROM probe_results p JOIN b USING (url) WHERE p.agent <> 'browser')
SELECT url, greatest(0, 100 - CASE WHEN any_value(fine) THEN 0 ELSE 50 END - CASE WHEN bool_or(waf) THEN 5 ELSE 0 END - {' - '.join(f"CASE WHEN bool_or(agent = '{a}' AND blocked) THEN {n} ELSE 0 END" for a, n in _BOTS)})::BIGINT AS score, bool_or(waf) AS waf,
  concat_ws(',', {', '.join(f"CASE WHEN bool_or(agent = '{a}' AND blocked) THEN '{a}' END" for a, _ in _BOTS)}) AS blocked FROM x GROUP BY url""")
def a23_bot_access(spark, sf_dir):
    return scoring.bot_access(view(spark, sf_dir, "probe_results"))


@query(f"""WITH {ctes('domain_signals')} SELECT domain, coalesce(floor(sum(score * w) FILTER (found) / sum(w) FILTER (found) + 0.5), 0)::BIGINT AS authority, count(*) FILTER (found) AS n_signals
FROM (SELECT *, (CASE signal WHEN 'kg' THEN 0.25 WHEN 'wikidata' THEN 0.20 ELSE 0.55 END)::DOUBLE AS w FROM domain_signals) GROUP BY domain""")
def a24_domain_authority(spark, sf_dir):
    return scoring.domain_authority(view(spark, sf_dir, "domain_signals"))


@query("""SELECT p_partkey AS id, ((d >= 10)::INT * 10 + (d >= 50)::INT * 10 + (d >= 200)::INT * 10 + (d >= 1000)::INT * 10 + (b >= 100)::INT * 10 + (b >= 1000)::INT * 10 + (b >= 10000)::INT * 10 + (r >= 100)::INT * 10 + (r >= 300)::INT * 10 + (r >= 500)::INT * 10)::BIGINT AS backlinks,
  (CASE WHEN w THEN 30 + (l > 0)::INT * 15 + (l > 5)::INT * 15 + (l > 20)::INT * 15 + (p_partkey % 2 = 0)::INT * 10 + (p_partkey % 5 <> 0)::INT * 15 ELSE 0 END)::BIGINT AS wikidata,
  (CASE WHEN k >= 10 THEN 30 + (k > 100)::INT * 20 + (k > 500)::INT * 15 + (p_partkey % 2 = 1)::INT * 15 + (p_partkey % 4 = 0)::INT * 20 ELSE 15 END)::BIGINT AS knowledge_graph
FROM (SELECT *, p_partkey * 7 % 1500 AS d, p_partkey * 91 % 20000 AS b, p_partkey * 13 % 1000 AS r, p_size % 30 AS l, p_partkey % 3 <> 0 AS w, p_partkey * 17 % 700 AS k FROM part)""")
def a25_authority_ladders(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = F.col("p_partkey")
    return t.select(
        n.alias("id"), scoring.backlink_score(n * 7 % 1500, n * 91 % 20000, n * 13 % 1000).cast("long").alias("backlinks"),
        scoring.wikidata_score(n % 3 != 0, F.col("p_size") % 30, n % 2 == 0, n % 5 != 0).cast("long").alias("wikidata"),
        scoring.knowledge_graph_score(n * 17 % 700, n % 2 == 1, n % 4 == 0).cast("long").alias("knowledge_graph"),
    )


def _alert_sql() -> str:
    order = ", ".join(_q(t) for t in TIER_ORDER)
    lag = ", ".join(f"lag({c}) OVER w AS prev_{c}" for c in ("score", *SUB_SCORES))
    subs = " ".join(
        f"""UNION ALL SELECT id, url, 'factor_regression', 'warning', '{c}', '{c} score dropped ' || (prev_{c} - {c}) || ' points', '{c} on ' || url || ': ' || prev_{c} || ' → ' || {c}, prev_{c}, {c} FROM p WHERE {c} - prev_{c} <= -15
        UNION ALL SELECT id, url, 'new_issue', 'warning', '{c}', '{c} dropped below threshold (20)', '{c} on ' || url || ' is now ' || {c} || ' (was ' || prev_{c} || ')', prev_{c}, {c} FROM p WHERE {c} < 20 AND prev_{c} >= 20"""
        for c in SUB_SCORES
    )
    return f"""WITH {_SCANS}, q AS (SELECT *, {lag} FROM scans WINDOW w AS (PARTITION BY project_id, url ORDER BY created_at, id)),
p AS (SELECT *, {_tier('score')} AS tier, {_tier('prev_score')} AS prev_tier FROM q WHERE prev_score IS NOT NULL)
SELECT id, url, 'score_drop' AS type, CASE WHEN score - prev_score <= -15 THEN 'critical' ELSE 'warning' END AS severity, NULL::VARCHAR AS factor, 'Score dropped ' || (prev_score - score) || ' points' AS title, url || ' score dropped from ' || prev_score || ' to ' || score AS message, prev_score AS previous_value, score AS current_value FROM p WHERE score - prev_score <= -5
UNION ALL SELECT id, url, 'score_improvement', 'info', NULL, 'Score improved ' || (score - prev_score) || ' points', url || ' score improved from ' || prev_score || ' to ' || score, prev_score, score FROM p WHERE score - prev_score >= 10
UNION ALL SELECT id, url, 'tier_change', CASE WHEN list_position([{order}], tier) > list_position([{order}], prev_tier) THEN 'info' ELSE 'critical' END, NULL, 'Tier ' || CASE WHEN list_position([{order}], tier) > list_position([{order}], prev_tier) THEN 'upgraded' ELSE 'downgraded' END || ': ' || prev_tier || ' → ' || tier,
  url || ' moved from ' || prev_tier || ' to ' || tier, NULL, NULL FROM p WHERE tier <> prev_tier {subs}"""


@query(_alert_sql())
def p31_score_alerts(spark, sf_dir):
    """P31 with the texts of P32."""
    return alerts.score_alerts(view(spark, sf_dir, "scans")).drop("project_id", "created_at")


@query(f"""WITH a AS ({_alert_sql()}) SELECT severity, count(*) AS n FROM a WHERE contains(lower(title), 'schema') OR contains(lower(message), 'schema') GROUP BY severity""")
def f9_alert_search(spark, sf_dir):
    found = alerts.matching(alerts.score_alerts(view(spark, sf_dir, "scans")), search="Schema")
    return found.groupBy("severity").agg(F.count("*").alias("n"))


@query(f"""WITH {ctes('projects', 'webhooks')}, a AS ({_alert_sql()}), o AS (SELECT a.id, a.type, p.organization_id FROM a JOIN scans_of s ON s.id = a.id JOIN projects p ON p.id = s.project_id), scans_of AS (SELECT event_id AS id, user_id AS project_id FROM events)
SELECT h.id AS webhook_id, o.type, count(*) AS deliveries FROM o JOIN webhooks h ON h.organization_id = o.organization_id AND h.active AND list_contains(string_split(h.events, ','), o.type) GROUP BY ALL""".replace("o AS (SELECT a.id", "@").replace(", scans_of AS (SELECT event_id AS id, user_id AS project_id FROM events)", "").replace("@", "scans_of AS (SELECT event_id AS id, user_id AS project_id FROM events), o AS (SELECT a.id"))
def j11_webhook_fan_out(spark, sf_dir):
    found = alerts.score_alerts(view(spark, sf_dir, "scans"))
    owner = view(spark, sf_dir, "projects").select(F.col("id").alias("project_id"), "organization_id")
    hooks = view(spark, sf_dir, "webhooks").withColumn("events", F.split("events", ","))
    sent = alerts.fan_out(found.join(owner, "project_id").select("organization_id", "type", "title", "message", "url"), hooks)
    return sent.groupBy("webhook_id", "type").agg(F.count("*").alias("deliveries"))


@query(f"""WITH {ctes('projects')}, s AS (SELECT event_id AS id, user_id AS project_id, ts AS created_at FROM events), a AS ({_alert_sql()}) SELECT a.id, a.type, a.title FROM a JOIN s ON s.id = a.id JOIN projects p ON p.id = s.project_id WHERE p.organization_id = 7 AND a.id % 3 <> 0 ORDER BY s.created_at DESC, a.id, a.title LIMIT 20""")
def f11_unread_alerts(spark, sf_dir):
    """The inbox of organization 7; alerts of every third scan count as read."""
    found = alerts.score_alerts(view(spark, sf_dir, "scans")).join(view(spark, sf_dir, "projects").select(F.col("id").alias("project_id"), "organization_id"), "project_id")
    found = found.withColumn("read_at", F.when(F.col("id") % 3 == 0, F.col("created_at"))).withColumn("scan", F.col("id")).withColumn("id", F.struct("scan", "title"))
    return alerts.unread(found, F.lit(7)).select(F.col("scan").alias("id"), "type", "title")


@query(f"""WITH {_SCANS}, q AS (SELECT *, lag(score) OVER (PARTITION BY project_id, url ORDER BY created_at, id) AS prev FROM scans)
SELECT id, project_id, 'Scan complete: ' || url || ' scored ' || score || '/100' || CASE WHEN prev IS NULL THEN '' ELSE ' (' || CASE WHEN score > prev THEN '+' ELSE '' END || (score - prev) || ')' END AS text, {_tier('score')} AS tier FROM q""")
def p33_messages(spark, sf_dir):
    return alerts.scan_messages(view(spark, sf_dir, "scans"))


@query(f"""WITH {ctes('scans', 'projects')}, r AS (SELECT p.organization_id, date_trunc('week', s.created_at)::DATE AS week, s.project_id, s.score FROM scans s JOIN projects p ON p.id = s.project_id),
w AS (SELECT organization_id, week, count(*) AS scans, count(DISTINCT project_id) AS projects, floor(avg(score) + 0.5)::BIGINT AS avg_score FROM r GROUP BY ALL)
SELECT a.organization_id, a.week, a.scans, a.projects, a.avg_score, b.avg_score AS last_score, CASE WHEN a.avg_score > b.avg_score THEN '+' ELSE '' END || (a.avg_score - b.avg_score) AS change FROM w a LEFT JOIN w b ON b.organization_id = a.organization_id AND b.week + 7 = a.week""")
def p33_weekly_digest(spark, sf_dir):
    return alerts.weekly_digest(view(spark, sf_dir, "scans"), view(spark, sf_dir, "projects"))
