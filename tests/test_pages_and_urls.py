"""Page analyzers, urls and raw inputs on hand-made pages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagegauge.operators import json_ld, pages, urls
from pagegauge.sources import readers

AS_OF = "TIMESTAMP_NTZ '2024-01-31 00:00:00'"
PAGE = """<html><head><title>Guide to Lakes</title><meta name="description" content="A short guide"><meta property='og:description' content="og"><link rel="canonical" href="https://a.com/blog/x/">
<link type="application/rss+xml" href="/rss"><script type="application/ld+json">{"@type":"Article","headline":"Guide to Lakes","datePublished":"2024-01-10","author":{"@type":"Person","name":"Ann Lee"}}</script>
<script type="application/ld+json">{"@graph":[{"@type":"FAQPage","mainEntity":[{"@type":"Question"}]}]}</script><script type="application/ld+json">{broken</script></head>
<body><nav><a href="/privacy">p</a><a href="/contact">c</a></nav><article><h1>Guide to Lakes</h1><p>A lake is a body of water that lies in a basin, and this first paragraph has more than fifty signs.</p>
<h2>What is deep?</h2><p>We tested 45% of Lake Victoria and Lake Geneva with Ann Lee. See <a href="https://en.wikipedia.org/x">this</a>.<ul><li>x</li></ul>
<h3>Key Takeaways</h3><p>you can swim.</p><img src="a.png" alt="a long text"></article><script>var x = 1</script></body></html>"""
EMPTY = ""
SPA = "<html><body><div id='root'></div><script></script></body></html>"


@pytest.fixture(scope="module")
def parts(spark):
    rows = [(0, "https://a.com/blog/x", PAGE, None, 150), (1, "http://a.com/?a=1&b=2&c=3", EMPTY, "", 1000), (2, "https://b.com/", SPA, "User-agent: *\nDisallow: /\n\nUser-agent: GPTBot\nAllow: /", 999), (3, "https://b.com/", None, None, None)]
    return pages.with_parts(spark.createDataFrame(rows, "page_id int, url string, html string, robots_txt string, ttfb_ms int")).cache()


def _by_id(df, *columns):
    return {r["page_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_text(parts):
    got = _by_id(pages.text_facts(parts), "n_words", "n_sentences", "body_text")
    assert got[1][:2] == (0, 0) and got[3][:2] == (0, 0) and "var x" not in got[0][2] and got[0][2].startswith("pcGuide to Lakes")


def test_structure(parts):
    got = _by_id(pages.structure(parts), "hierarchy_valid", "h1_count", "list_count", "paragraph_count", "structure_score")
    assert got[0] == (True, 1, 1, 2, 10 + 15 + 5 + 10 + 5 + 10 + 10 + 5) and got[1] == (False, 0, 0, 0, 0)


def test_summaries(parts):
    got = _by_id(pages.summaries(parts), "meta_description_length", "has_definition", "has_tldr", "summary_score")
    assert got[0] == (13, True, True, 10 + 10 + 10 + 8 + 20 + 20) and got[1] == (0, False, False, 0)


def test_entities_and_quality(parts):
    got = _by_id(pages.entities(parts), "long_names", "entity_count")
    assert got[0][0] == ["Lake Victoria", "Lake Geneva", "Ann Lee"] or set(got[0][0]) >= {"Lake Victoria", "Ann Lee"}
    assert _by_id(pages.quality(parts), "alt_coverage", "self_contained", "quality_tldr")[0] == (100, 0, True)


def test_access_and_robots(parts):
    got = _by_id(pages.access(parts), "is_https", "has_canonical", "clean_url", "is_spa", "access_score")
    assert got[0] == (True, True, True, False, 15 + 15 + 15 + 10 + 10 + 10)
    assert got[1] == (False, False, False, False, 15 + 10) and got[2][3] and got[2][4] == 15 + 15 + 10 + 5 + 5 + 3


def test_robots_rules(spark):
    texts = ["User-agent: *\nDisallow: /\n\nUser-agent: GPTBot\nAllow: /", "", "User-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /", None, "user-agent: *\r\ndisallow: /\r\ncrawl-delay: 12\r\nSitemap: https://a.com/s.xml\r\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", pages.robots_summary(F.col("t")).alias("r"))
    got = [tuple(r["r"][c] for c in ("exists", "gptbot", "claudebot", "googlebot")) for r in df.orderBy("i").collect()]
    assert got == [(True, True, False, False), (False, True, True, True), (True, True, False, True), (False, True, True, True), (True, False, False, False)]
    last = df.where("i = 4").first()["r"]
    assert last["has_sitemap"] and last["crawl_delay"] == 12


def test_richness_author_and_links(parts):
    rows = pages.dates_and_author(pages.links_of(parts), F.expr(AS_OF))
    got = _by_id(pages.richness(rows), "statistics", "external_hosts", "fresh", "author", "n_trust_links", "richness_score")
    assert got[0] == (1, ["en.wikipedia.org"], True, "Ann Lee", 2, 10 + 10 + 5 + 5 + 5 + 10 + 15 + 10)
    trust = _by_id(pages.author_trust(rows), "trust_pages", "authority_links", "author_score")
    assert trust[0] == (2, 1, 20 + 5 + 10 + 10 + 8) and trust[3] == (0, 0, 0)


def test_faq_feeds_type_and_rest(parts):
    assert _by_id(pages.faq(parts), "faq_schema", "question_headings")[0] == (True, 1)
    assert _by_id(pages.feeds(parts), "n_rss", "has_sitemap", "feed_score")[0] == (1, False, 25)
    assert {i: t for i, (t,) in _by_id(parts.select("page_id", pages.page_type(F.col("tree"), F.col("ld")).alias("t")), "t").items()} == {0: "article", 1: "homepage", 2: "homepage", 3: "homepage"}
    assert _by_id(pages.information_gain(parts), "novelty", "gain_score")[0] == (["Original research detected", "First-hand experience language"], 55)
    assert _by_id(pages.conversational(parts), "question_ratio")[0][0] == pytest.approx(1 / 3)
    assert _by_id(pages.topical_depth(pages.links_of(parts)), "n_subtopics")[0] == (2,)
    assert _by_id(pages.sensitivity(pages.links_of(parts)), "is_ymyl", "trust_score")[0] == (False, 100)


def test_sensitive_page(spark):
    html = "<body><p>" + "medical doctor treatment words here " * 5 + "not medical advice</p><time datetime='x'></time></body>"
    rows = pages.with_parts(spark.createDataFrame([(1, "https://a.com", html)], "page_id int, url string, html string"))
    row = pages.sensitivity(pages.links_of(rows)).first()
    assert row["ymyl_category"] == "health-medical" and row["ymyl_confidence"] == "high" and row["missing"] == ["namedAuthor", "authorCredentials", "primarySources"] and row["trust_score"] == 40


def test_json_ld(parts, spark):
    rows = json_ld.with_json_ld(parts)
    got = _by_id(json_ld.schema_score(rows), "schema_types", "is_article", "is_faqPage", "is_speakable", "schema_score")
    assert got[0] == (["Article", "FAQPage", "Person"], True, True, False, 20 + 15 + 30 + 5) and got[3] == ([], False, False, False, 0)
    assert _by_id(json_ld.schema_accuracy(rows, F.expr(AS_OF)), "n_issues", "accuracy_score")[0] == (1, 95)
    assert _by_id(json_ld.hallucination_risk(rows, F.expr(AS_OF)), "contradictions", "inconsistencies", "risk_level")[0] == (0, 0, "low")


def test_contradictions(spark):
    html = '<script type="application/ld+json">{"headline":"Other","dateModified":"2030-01-01","aggregateRating":{"ratingValue":"7"},"author":"Bob Roe"}</script><body><h1>Title</h1></body>'
    rows = json_ld.with_json_ld(pages.with_parts(spark.createDataFrame([(1, html)], "page_id int, html string")))
    row = json_ld.hallucination_risk(rows, F.expr(AS_OF)).first()
    assert (row["contradictions"], row["risk_level"]) == (2, "high")


def test_urls(spark):
    given = {"https://A.com": ("https://a.com/", None), "http://10.1.2.3/x": ("http://10.1.2.3/x", "private_host"), "ftp://a.com/": (None, "scheme"), "https://a.com/x/?q=1#f": ("https://a.com/x?q=1", None), "https://a.com:443/": ("https://a.com/", None), "http://172.20.0.1/": ("http://172.20.0.1/", "private_host"), "nothing": (None, "invalid"), "http://x.internal": ("http://x.internal/", "private_host")}
    df = spark.createDataFrame([(u,) for u in given], "u string")
    assert {r["u"]: (r["n"], r["r"]) for r in df.select("u", urls.normal_url(F.col("u")).alias("n"), urls.url_reject_reason(F.col("u")).alias("r")).collect()} == given


def test_links(spark):
    html = "<a href='/a'>x</a><a href='b'>x</a><a href='https://a.com/c#d'></a><a href='//other.com/'></a><a href='mailto:x@a.com'></a><a href='/i.png'></a><a href='/wp-admin/x'></a><a href='?p=2'></a>"
    df = spark.createDataFrame([(1, "https://a.com/dir/page", html)], "page_id int, url string, html string")
    assert sorted(r["link"] for r in urls.page_links(df).collect()) == ["https://a.com/a", "https://a.com/c", "https://a.com/dir/b", "https://a.com/dir/page?p=2"]


def test_discovery_first_source_wins(spark):
    row = lambda *r: spark.createDataFrame(list(r), "site string, url string, ord long")
    maps = spark.createDataFrame([("s", "https://s/a", 0, 0.9), ("s", "https://s", 1, 0.1), ("s", "bad", 2, 1.0)], "site string, url string, ord long, priority double")
    out = urls.discovered(row(("s", "https://s/", 0)), maps, row(("s", "https://s/a/", 0), ("s", "https://s/b", 1)), 2).orderBy("position").collect()
    assert [(r["url"], r["source"], r["priority"]) for r in out] == [("https://s/", "homepage", 1.0), ("https://s/a", "sitemap", 0.9)]


def test_sitemaps(spark):
    xml = "<url><loc>https://a/1</loc><priority>0.9</priority></url><url><loc>https://a/2</loc><lastmod>x</lastmod><priority>0.9</priority></url><url><loc>https://a/3</loc><priority>abc</priority></url>"
    df = spark.createDataFrame([("a", "u", xml)], "site string, sitemap_url string, xml string")
    assert [(r["url"], r["priority"]) for r in readers.sitemap_urls(df).orderBy("ord").collect()] == [("https://a/1", 0.9), ("https://a/2", 0.5), ("https://a/3", 0.5)]
    index = spark.createDataFrame([("a", "".join(f"<sitemap><loc>https://a/{i}</loc></sitemap>" for i in range(9)))], "site string, xml string")
    assert readers.child_sitemaps(index).count() == 5


def test_stored_fixes(spark):
    good = '{"description":"d","points":5,"layer":"access","factorId":"1","priority":1}'
    given = [f"[{good},{good.replace('access', 'x')},{good.replace('5', 'null')}]", "{}", "nonsense", None]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, j string")
    assert [r["n"] for r in df.select("i", F.size(readers.parsed_fixes(F.col("j"))).alias("n")).orderBy("i").collect()] == [1, 0, 0, 0]


def test_admission(spark):
    rows = [(200, None, "x"), (301, None, "x"), (404, "text/html", "x"), (None, "text/html", "x"), (200, "application/pdf", "x"), (200, "application/xhtml+xml; q", "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, status int, content_type string, html string")
    assert [r["reject_reason"] for r in readers.admitted(df).orderBy("i").collect()] == [None, "redirect_not_followed", "http_error", "http_error", "not_html", None]
