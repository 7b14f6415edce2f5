"""Queries over pages, urls and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..operators import entities, json_ld, pages, urls
from ..sources import readers
from ..sources.bridge import AS_OF
from ..sources.stored import stored
from .registry import ORACLE, query


def _as_of():
    return F.expr(f"TIMESTAMP_NTZ '{AS_OF}'")


def _raw(spark, sf_dir):
    """``pages`` with the fetch facts that the table lacks, made from the page's number."""
    n = F.col("page_id")
    robots = F.when(n % 4 == 0, "User-agent: *\nDisallow: /\n\nUser-agent: GPTBot\nAllow: /\nSitemap: https://example.com/sitemap.xml\n").when(n % 4 == 1, "User-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /\nCrawl-delay: 7\n").when(n % 4 == 2, "")
    return readers.spread(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumns({"robots_txt": robots, "ttfb_ms": (n * 37 % 1500).cast("int"), "status": F.when(n % 23 == 0, 301).when(n % 19 == 0, 404).otherwise(200), "content_type": F.when(n % 17 == 0, "application/pdf").otherwise("text/html; charset=utf-8")})


def _parts(spark, sf_dir):
    return pages.with_parts(_raw(spark, sf_dir))


def _landmarks(spark, sf_dir):
    return pages.with_parts(_raw(spark, sf_dir), H.LANDMARKS)


# the same cuts in DuckDB: its regular expressions have no look-ahead, so paragraphs are taken by splitting
_SEEN = r"regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g')"
_BODY = r"CASE WHEN regexp_extract(seen, '(?is)<body[^>]*>(.*?)(?:</body>|$)', 1) <> '' THEN regexp_extract(seen, '(?is)<body[^>]*>(.*?)(?:</body>|$)', 1) ELSE seen END"
_MAIN = r"CASE WHEN regexp_extract(seen, '(?is)<(?:main|article)\b[^>]*>(.*?)(?:</main>|</article>|$)', 1) <> '' THEN regexp_extract(seen, '(?is)<(?:main|article)\b[^>]*>(.*?)(?:</main>|</article>|$)', 1) ELSE " + _BODY + " END"


def _text(part: str) -> str:
    out = f"regexp_replace({part}, '<[^>]*>', '', 'g')"
    for code, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{code}', '{sign}')"
    return f"trim(regexp_replace({out}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


# the fetch facts that ``_raw`` makes
_ROBOTS = r"""CASE page_id % 4 WHEN 0 THEN replace('User-agent: *|Disallow: /||User-agent: GPTBot|Allow: /|Sitemap: https://example.com/sitemap.xml|', '|', chr(10)) WHEN 1 THEN replace('User-agent: GPTBot|User-agent: ClaudeBot|Disallow: /|Crawl-delay: 7|', '|', chr(10)) WHEN 2 THEN '' END"""
# a robots.txt line by line: which agents a rule is under, and the last rule for "/" that is under a bot or all
_VERDICTS = f"""rb AS (SELECT page_id, {_ROBOTS} AS robots FROM pages),
rl AS (SELECT page_id, unnest(string_split(coalesce(robots, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(robots, ''), chr(10)), 1) AS i FROM rb),
ra AS (SELECT *, CASE WHEN regexp_matches(line, '(?i)^user-agent:') THEN lower(trim(regexp_replace(line, '(?i)^user-agent:\\s*', ''))) END AS agent FROM rl),
rg AS (SELECT *, last_value(agent IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS under FROM ra),
rv AS (SELECT page_id, regexp_matches(line, '(?i)^allow:\\s*/\\s*$') AS allow, under, i FROM rg WHERE regexp_matches(line, '(?i)^(dis)?allow:\\s*/\\s*$')),
verdicts AS (SELECT rb.page_id, length(trim(coalesce(any_value(robots), ''))) > 0 AS exists, {", ".join(f"coalesce(arg_max(allow, i) FILTER (under IN ('*', '{b}')), true) AS {b}" for b in ("googlebot", "gptbot", "claudebot", "perplexitybot"))},
  coalesce(regexp_matches(any_value(robots), '(?im)^\\s*sitemap:'), false) AS has_sitemap, TRY_CAST(regexp_extract(any_value(robots), '(?im)^crawl-delay:\\s*(\\d+)', 1) AS INTEGER) AS crawl_delay FROM rb LEFT JOIN rv ON rv.page_id = rb.page_id GROUP BY rb.page_id)"""


def _points(*rules: tuple[str, int]) -> str:
    """A score of 100 at most: the points of the rules that hold."""
    return "least(100, " + " + ".join(f"CASE WHEN {rule} THEN {n} ELSE 0 END" for rule, n in rules) + ")::BIGINT"


def _above(x: str, *steps: tuple[float, int]) -> list[tuple[str, int]]:
    return [(f"{x} >= {least}", n) for least, n in steps]


def _matches(text: str, patterns) -> str:
    """How often the patterns of ``pages`` are found."""
    return "(" + " + ".join("len(regexp_extract_all({}, '{}'))".format(text, p.replace("'", "''")) for p in patterns) + ")"


def _some(text: str, patterns) -> str:
    return f"{_matches(text, patterns)} > 0"


_HEADS = r"""(list_filter(list_transform(list_zip(regexp_extract_all(seen, '(?is)<h([1-6])(?:\s[^>]*)?>(.*?)</h[1-6]>', 1), regexp_extract_all(seen, '(?is)<h([1-6])(?:\s[^>]*)?>(.*?)</h[1-6]>', 2)), lambda x: {'level': x[1]::INTEGER, 'text': """ + _text("x[2]") + r"""}), lambda h: h.text <> ''))"""


# a paragraph ends where the next block begins
def _paragraphs(part: str) -> str:
    return r"""list_filter(list_transform(list_filter(string_split(regexp_replace(""" + part + r""", '(?i)<p(?:\s[^>]*)?>', chr(1) || chr(2), 'g'), chr(1)), lambda x: starts_with(x, chr(2))), lambda x: """ + _text(r"""regexp_replace(substr(x, 2), '(?is)(?:<p[\s>]|</p>|<h[1-6][\s>]|<div[\s>]|</div>|<ul[\s>]|<ol[\s>]|<table[\s>]|</article>|</main>|</body>|<footer[\s>]).*$', '')""") + r"""), lambda t: t <> '')"""


_MARKED = f"""list_concat(list_transform(heads, lambda h: h.text), list_transform(regexp_extract_all(seen, '(?is)<(?:strong|b)(?:\\s[^>]*)?>(.*?)</(?:strong|b)>', 1), lambda x: {_text('x')}))"""
_LINKS = r"""list_filter(list_transform(regexp_extract_all(seen, '(?is)<a\s[^>]*>'), lambda t: CASE WHEN regexp_matches(t, '(?is)\shref\s*=\s*(?:"([^"]*)"|''([^'']*)'')') THEN replace(regexp_extract(t, '(?is)\shref\s*=\s*(?:"([^"]*)"|''([^'']*)'')', 1) || regexp_extract(t, '(?is)\shref\s*=\s*(?:"([^"]*)"|''([^'']*)'')', 2), '&amp;', '&') END), lambda h: h IS NOT NULL)"""
_STOPS = ", ".join(f"'{w}'" for w in pages.STOP_WORDS)
_RUNS = rf"""en AS (SELECT *, {_text(r"regexp_replace(main, '(?is)<nav\b.*?</nav>|<footer\b.*?</footer>|<header\b.*?</header>', '', 'g')")} AS entity_text FROM p),
er AS (SELECT *, flatten(list_transform(string_split_regex(entity_text, '[.!?]+'), lambda s: list_filter(list_transform(string_split(array_to_string(list_transform(list_filter(string_split(trim(s), ' '), lambda w: w <> '')[2:], lambda w: CASE WHEN regexp_matches(w, '^[A-Z][a-z]+') AND lower(w) NOT IN ({_STOPS}) THEN w ELSE chr(1) END), ' '), chr(1)), lambda r: trim(r)), lambda r: r <> ''))) AS runs FROM en),
names AS (SELECT *, list_distinct(flatten(list_transform(runs, lambda r: string_split(r, ' ')))) AS single, list_distinct(list_filter(runs, lambda r: contains(r, ' '))) AS multi, len(list_filter(string_split(entity_text, ' '), lambda w: w <> '')) AS entity_words FROM er)"""

_PARTS = f"s AS (SELECT *, {_SEEN} AS seen FROM pages), m AS (SELECT *, {_MAIN} AS main, {_text('(' + _BODY + ')')} AS body_text FROM s), t AS (SELECT *, {_text('main')} AS text FROM m), p AS (SELECT *, list_filter(string_split(text, ' '), lambda w: w <> '') AS words FROM t)"


_NORM = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


# blocks of JSON-LD by page number, as the driver's pages have none
_BLOCKS = (
    "",
    '{"@type": "Article", "headline": "Weekly notes", "author": {"@type": "Person", "name": "Ann Lee", "jobTitle": "Editor"}, "datePublished": "2024-01-10"}',
    '{"@type": "Product", "name": "Widget", "datePublished": "2031-05-01", "aggregateRating": {"@type": "AggregateRating", "ratingValue": 7, "bestRating": 5}}',
    '{"@type": }',
    '[{"@type": "Organization", "name": ""}, {"@type": "WebSite", "speakable": {"@type": "SpeakableSpecification"}}]',
    '{"@graph": [{"@type": "Person", "name": "Bo Dean", "description": "Writes about lakes"}, {"@type": "FAQPage"}], "mainEntity": [1, 2, 3]}',
    '{"author": {"name": "Cy Fox", "knowsAbout": ["lakes"]}, "dateModified": "2024-01-20", "@type": ["Article", "Thing"], "parts": [{"@type": "Hidden", "speakable": 1}]}',
    '{"description": "' + "A long description of a page. " * 200 + '", "publisher": {"@type": "Corporation", "logo": {"@type": "ImageObject"}}, "@type": "Organization"}',
)


def _marked_up(spark, sf_dir):
    """``pages`` with a block of JSON-LD before some."""
    block = F.get(F.array(*map(F.lit, _BLOCKS)), (F.col("page_id") % len(_BLOCKS)).cast("int"))
    return _raw(spark, sf_dir).withColumn("html", F.concat(F.when(block == "", "").otherwise(F.concat(F.lit('<script type="application/ld+json">'), block, F.lit("</script>"))), F.coalesce("html", F.lit(""))))


def _json_sql() -> str:
    """``item``: the objects of the blocks and of their ``@graph``, parsed; ``kind``: types, badness and whether something is speakable, by block."""
    rows = ", ".join("({}, '{}')".format(k, b.replace("'", "''")) for k, b in enumerate(_BLOCKS))
    text = lambda key: f"CASE WHEN json_type(o, '$.{key}') NOT IN ('OBJECT', 'ARRAY') THEN nullif(json_extract_string(o, '$.{key}'), '') END"
    names = (("headline", "headline"), ("name", "name"), ("description", "description"), ("published", "datePublished"), ("modified", "dateModified"), ("created", "dateCreated"))
    return rf"""blk(k, b) AS (VALUES {rows}),
good AS (SELECT k, b::JSON AS j FROM blk WHERE json_valid(b)),
above AS (SELECT k, o, pos FROM (SELECT k, unnest(list) AS o, unnest(range(len(list))) AS pos FROM (SELECT k, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END AS list FROM good)) WHERE json_type(o) = 'OBJECT'),
below AS (SELECT k, pos, unnest(json_extract(o, '$."@graph"[*]')) AS o FROM above),
item AS (SELECT *, coalesce(json_extract_string(o, '$."@type"'), '') AS type, {", ".join(f"{text(key)} AS {name}" for name, key in names)}, {text("author.name")} AS author_name, coalesce({text("author.name")}, {text("author")}) AS author
  FROM (SELECT k, pos, true AS top, o FROM above UNION ALL SELECT k, pos, false, o FROM below WHERE json_type(o) = 'OBJECT')),
found AS (SELECT k, t.key, t.atom, regexp_replace(t.fullkey, '"?@graph"?\[\d+\]', '', 'g') AS place FROM good, json_tree(CASE WHEN json_type(j) = 'ARRAY' THEN j ELSE json_array(j) END) t),
kind AS (SELECT blk.k, blk.b <> '' AND NOT json_valid(blk.b) AS bad, coalesce(list(DISTINCT lower(json_extract_string(atom, '$'))) FILTER (regexp_matches(place, '^\$\[\d+\][^\[]*"@type"(\[\d+\])?$') AND atom IS NOT NULL), []) AS types,
  coalesce(bool_or(key = 'speakable'), false) AS speakable, (SELECT count(*) FROM above WHERE above.k = blk.k) AS objects FROM blk LEFT JOIN found ON found.k = blk.k GROUP BY blk.k, blk.b)"""


_JSON = _json_sql()
# the pages with the blocks before them
_MARKED_UP = f"mp AS (SELECT p.*, p.page_id % {len(_BLOCKS)} AS k FROM p)"
_FUZZY = lambda a, b: f"({_NORM.format(x=a)} = {_NORM.format(x=b)} OR contains({_NORM.format(x=a)}, {_NORM.format(x=b)}) OR contains({_NORM.format(x=b)}, {_NORM.format(x=a)}))"
_LD = f"""ld AS (SELECT *, {_HEADS} AS heads, {_text("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, trim(regexp_extract(html, '(?is)<meta\\s[^>]*name=["'']description["''][^>]*content=["'']([^"'']*)', 1)) AS about FROM mp),
lt AS (SELECT *, coalesce(list_filter(heads, lambda h: h.level = 1)[1].text, '') AS h1 FROM ld)"""


@query(f"WITH {_PARTS} SELECT page_id, len(words)::INTEGER AS n_words, len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: length(trim(x)) > 0))::INTEGER AS n_sentences, length(text)::INTEGER AS chars FROM p")
def p1_text_facts(spark, sf_dir):
    return pages.text_facts(_parts(spark, sf_dir)).select("page_id", "n_words", "n_sentences", F.length("text").alias("chars"))


@query(r"""WITH """ + _PARTS + r""", h AS (SELECT page_id, list_filter(list_zip(regexp_extract_all(seen, '(?is)<h([1-6])(?:\s[^>]*)?>(.*?)</h[1-6]>', 1), regexp_extract_all(seen, '(?is)<h([1-6])(?:\s[^>]*)?>(.*?)</h[1-6]>', 2)), lambda x: trim(regexp_replace(x[2], '<[^>]*>', '', 'g')) <> '') AS hs, seen FROM p)
SELECT page_id, len(hs)::INTEGER AS n_headings, len(list_filter(hs, lambda x: x[1] = '1'))::INTEGER AS h1_count, len(regexp_extract_all(seen, '(?i)<(?:ul|ol)[\s/>]'))::INTEGER AS list_count, len(regexp_extract_all(seen, '(?i)<(?:table)[\s/>]'))::INTEGER AS table_count FROM h""")
def p4_headings(spark, sf_dir):
    return pages.structure(_parts(spark, sf_dir)).select("page_id", F.size("headings").alias("n_headings"), "h1_count", "list_count", "table_count")


_STRUCTURE = f"""ps AS (SELECT *, {_HEADS} AS heads, list_filter({_paragraphs('seen')}, lambda t: length(t) > 20) AS paras FROM p),
st AS (SELECT *, len(list_filter(heads, lambda h: h.level = 1)) AS h1, len(list_filter(range(1, len(heads)), lambda i: heads[i + 1].level > heads[i].level + 1)) = 0 AS even, coalesce(list_sum(list_transform(paras, lambda t: len(string_split(t, ' ')))), 0)::INTEGER AS word_count, len(paras) AS n_paras,
  len(regexp_extract_all(seen, '(?i)<(?:ul|ol)[\\s/>]')) AS lists, len(regexp_extract_all(seen, '(?i)<(?:table)[\\s/>]')) AS tables FROM ps),
sa AS (SELECT *, CASE WHEN n_paras > 0 THEN floor(word_count / n_paras::DOUBLE + 0.5)::BIGINT ELSE 0 END AS average FROM st)"""


@query(f"""WITH {_PARTS}, {_STRUCTURE} SELECT page_id, even AND h1 = 1 AS hierarchy_valid, word_count, n_paras::INTEGER AS paragraph_count, average::BIGINT AS avg_paragraph,
  {_points(("len(heads) > 0", 10), ("even AND h1 = 1", 15), ("h1 = 1", 5), ("len(list_filter(heads, lambda h: h.level = 2)) > 0", 10), ("len(list_filter(heads, lambda h: h.level = 3)) > 0", 5), *_above("lists", (1, 10), (3, 5)), ("tables > 0", 10), *_above("word_count", (300, 5), (800, 5), (1500, 5)), ("average > 0 AND average <= 80", 10), ("average > 0 AND average <= 50", 5))} AS structure_score FROM sa""")
def p4_structure(spark, sf_dir):
    return pages.structure(_parts(spark, sf_dir)).select("page_id", "hierarchy_valid", "word_count", "paragraph_count", "avg_paragraph", "structure_score")


@query(f"""WITH {_PARTS}, q AS (SELECT *, {_HEADS} AS heads, {_paragraphs('main')} AS paras, trim(regexp_extract(html, '(?is)<meta\\s[^>]*name=["'']description["''][^>]*content=["'']([^"'']*)', 1)) AS md FROM p),
o AS (SELECT *, list_filter(paras, lambda t: length(t) >= 50)[1] AS opening, list_filter(paras, lambda t: length(t) >= 30)[1:3] AS firsts, {_MARKED} AS marked FROM q),
f AS (SELECT *, length(md) AS n, CASE WHEN opening IS NULL THEN 0 ELSE len(string_split(opening, ' ')) END AS w, len(list_filter(firsts, lambda t: {_some("t", pages.DEFINITIONS)})) > 0 AS has_definition, len(list_filter(marked, lambda t: {" OR ".join(f"contains(lower(t), '{x}')" for x in pages.TLDR_SUMMARY)})) > 0 AS has_tldr FROM o)
SELECT page_id, n::INTEGER AS meta_description_length, w::INTEGER AS opening_words, has_definition, has_tldr, {_points(("n > 0", 10), ("n BETWEEN 120 AND 160", 15), ("n >= 70 AND NOT n BETWEEN 120 AND 160", 8), ("opening IS NOT NULL", 10), ("w BETWEEN 30 AND 80", 15), ("w >= 20 AND NOT w BETWEEN 30 AND 80", 8), ("has_definition", 20), ("has_tldr", 20))} AS summary_score FROM f""")
def p6_summaries(spark, sf_dir):
    return pages.summaries(_parts(spark, sf_dir)).select("page_id", "meta_description_length", "opening_words", "has_definition", "has_tldr", "summary_score")


@query(f"""WITH {_PARTS}, {_JSON}, {_RUNS}, d AS (SELECT *, len(list_distinct(list_concat(single, multi))) AS n, len(multi) AS n_long FROM names), e AS (SELECT *, CASE WHEN entity_words > 0 THEN n / entity_words::DOUBLE * 100 ELSE 0 END AS density FROM d)
SELECT page_id, n::INTEGER AS entity_count, n_long::INTEGER AS n_long, floor(density * 100 + 0.5) / 100 AS entity_density, {_points(*_above("density", (1, 15), (2, 15), (3, 10)), *_above("n", (5, 10), (10, 10), (20, 5)), *_above("n_long", (2, 10), (5, 5)), (r"""regexp_matches(seen, '(?i)rel=["'']author["'']|class=["''][^"'']*(author|byline)')""", 10), (f"EXISTS (SELECT 1 FROM item i WHERE i.top AND i.k = page_id % {len(_BLOCKS)} AND i.type IN ('Organization', 'Corporation'))", 10))} AS entity_score FROM e""")
def p8_entities(spark, sf_dir):
    return pages.entities(pages.with_parts(_marked_up(spark, sf_dir))).select("page_id", "entity_count", F.size("long_names").alias("n_long"), "entity_density", "entity_score")


@query(r"""WITH """ + _PARTS + r""", q AS (SELECT *, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM p) SELECT page_id, starts_with(lower(url), 'https:') AS is_https, q = '' OR len(string_split(q, '&')) <= 2 AS clean_url, (length(body_text) < 100 AND len(regexp_extract_all(html, '(?i)<(?:script)[\s/>]')) > 3) OR (regexp_matches(html, '(?i)id=["''](root|app)["'']') AND length(body_text) < 200) AS is_spa, (page_id * 37 % 1500)::INTEGER AS ttfb_ms FROM q""")
def p9_access_facts(spark, sf_dir):
    return pages.access(_parts(spark, sf_dir)).select("page_id", "is_https", "clean_url", "is_spa", "ttfb_ms")


@query(rf"""WITH {_PARTS}, {_VERDICTS}, q AS (SELECT *, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q, page_id * 37 % 1500 AS t FROM p),
f AS (SELECT *, starts_with(lower(url), 'https:') AS is_https, regexp_matches(html, '(?is)<link\s[^>]*rel=["'']canonical["''][^>]*href=') AS has_canonical, NOT regexp_matches(html, '(?is)<meta\s[^>]*name=["'']robots["''][^>]*noindex') AS is_indexable, regexp_matches(html, '(?is)<link\s[^>]*\shreflang=') AS has_hreflang,
  q = '' OR len(string_split(q, '&')) <= 2 AS clean, (length(body_text) < 100 AND len(regexp_extract_all(html, '(?i)<(?:script)[\s/>]')) > 3) OR (regexp_matches(html, '(?i)id=["''](root|app)["'']') AND length(body_text) < 200) AS is_spa FROM q)
SELECT page_id, is_https, has_canonical, is_indexable, has_hreflang, {_points(("is_https", 15), ("has_canonical", 15), ("is_indexable", 15), ("clean", 10), ("has_hreflang", 5), ("NOT is_spa", 10), ("exists", 5), ("exists AND googlebot", 5), ("exists AND gptbot", 5), ("exists AND claudebot", 5), ("t < 200", 10), ("t >= 200 AND t < 500", 7), ("t >= 500 AND t < 1000", 3))} AS access_score FROM f JOIN verdicts USING (page_id)""")
def p9_crawl_access(spark, sf_dir):
    return pages.access(_parts(spark, sf_dir)).select("page_id", "is_https", "has_canonical", "is_indexable", "has_hreflang", "access_score")


_HOST_OF = r"lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:]*)', 1))"
_OUTSIDE = rf"""lk AS (SELECT *, {_LINKS} AS hrefs FROM p), lo AS (SELECT *, list_filter(list_filter(hrefs, lambda h: regexp_matches(h, '(?i)^(https?:)?//[^/]')), lambda h: {_HOST_OF.format(u='h')} <> {_HOST_OF.format(u='url')}) AS outside, len(list_filter(hrefs, lambda h: regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT regexp_matches(h, '(?i)^https?://'))) AS other FROM lk)"""
_IMAGES = r"""regexp_extract_all(seen, '(?is)<img\s[^>]*>')"""
_ALTS = rf"""len(list_filter({_IMAGES}, lambda t: length(trim(regexp_extract(t, '(?is)\salt\s*=\s*(?:"([^"]*)"|''([^'']*)'')', 1) || regexp_extract(t, '(?is)\salt\s*=\s*(?:"([^"]*)"|''([^'']*)'')', 2))) > 5))"""
# the pages of the driver have no JSON-LD: dates and authors come from meta, time and author elements
_DATED = r"""dt AS (SELECT *, nullif(coalesce(nullif(trim(regexp_extract(seen, '(?is)<meta\s[^>]*property=["'']article:(?:modified|published)_time["''][^>]*content=["'']([^"'']*)', 1)), ''), nullif(regexp_extract(seen, '(?is)<time[^>]*\sdatetime=["'']([^"'']*)', 1), '')), '') AS dated,
  nullif(""" + _text(r"""regexp_extract(seen, '(?is)<[a-z]+[^>]*(?:rel=["'']author["'']|class=["''][^"'']*(?:author|byline)[^"'']*["''])[^>]*>(.*?)</', 1)""") + r""", '') AS author, lower(array_to_string(hrefs, ' ')) AS link_text FROM lo)"""


@query(rf"""WITH {_PARTS}, {_OUTSIDE}, {_DATED}, f AS (SELECT *, {_matches('text', pages.STATISTICS)} AS statistics, len(list_distinct(list_transform(outside, lambda h: {_HOST_OF.format(u='h')}))) AS hosts, len({_IMAGES}) AS images, {_ALTS} AS alts,
  len(list_filter(hrefs, lambda h: contains(h, 'privacy') OR contains(h, 'terms') OR contains(h, 'contact'))) AS trust, regexp_matches(seen, '(?i)<video[\s>]|<iframe[^>]*src=["''][^"'']*(youtube|vimeo|wistia)') AS video, coalesce(TRY_CAST(dated AS TIMESTAMP) < TIMESTAMP '{AS_OF}' AND TRY_CAST(dated AS TIMESTAMP) > TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY, false) AS fresh FROM dt)
SELECT page_id, statistics::INTEGER AS statistics, hosts::INTEGER AS n_hosts, images::INTEGER AS n_images, trust::INTEGER AS n_trust_links,
  {_points(*_above("statistics", (1, 10), (3, 5), (5, 5)), *_above("hosts", (1, 10), (3, 5), (5, 5)), *_above("images", (1, 5), (2, 5)), ("alts > 0 AND alts >= images * 0.8", 5), ("video", 5), ("dated IS NOT NULL", 5), ("fresh", 10), ("author IS NOT NULL", 15), ("trust >= 2", 10))} AS richness_score FROM f""")
def p10_content_richness(spark, sf_dir):
    rows = pages.dates_and_author(pages.links_of(_parts(spark, sf_dir)), _as_of())
    return pages.richness(rows).select("page_id", "statistics", F.size("external_hosts").alias("n_hosts"), "n_images", "n_trust_links", "richness_score")


@query(rf"""WITH {_PARTS}, {_OUTSIDE}, {_DATED}, {_JSON},
who AS (SELECT k, arg_max(coalesce(CASE WHEN top THEN author_name WHEN type = 'Person' THEN name END), pos * 2 + (NOT top)::INTEGER) FILTER (CASE WHEN top THEN author_name WHEN type = 'Person' THEN name END IS NOT NULL) AS named,
  bool_or(CASE WHEN top THEN json_extract(o, '$.author.description') IS NOT NULL ELSE type = 'Person' AND name IS NOT NULL AND description IS NOT NULL END) AS wrote,
  bool_or(CASE WHEN top THEN json_extract(o, '$.author.jobTitle') IS NOT NULL OR json_extract(o, '$.author.knowsAbout') IS NOT NULL ELSE type = 'Person' AND name IS NOT NULL AND (json_extract(o, '$.jobTitle') IS NOT NULL OR json_extract(o, '$.knowsAbout') IS NOT NULL) END) AS works,
  coalesce(max(modified) FILTER (top), max(published) FILTER (top)) AS stated FROM item GROUP BY k),
md AS (SELECT dt.* EXCLUDE (author, dated), coalesce(who.stated, dt.dated) AS dated, coalesce(who.named, dt.author) AS author, coalesce(who.wrote, false) AS wrote, coalesce(who.works, false) AS works FROM dt LEFT JOIN who ON who.k = dt.page_id % {len(_BLOCKS)}),
f AS (SELECT *, array_to_string(list_transform(regexp_extract_all(seen, '(?is)<[a-z]+[^>]*class=["''][^"'']*author[^"'']*["''][^>]*>(.*?)</(?:div|section|p|span|aside)>', 1), lambda x: {_text("x")}), '') AS section,
  len(list_filter(list_distinct(list_transform(outside, lambda h: {_HOST_OF.format(u='h')})), lambda h: {" OR ".join(f"contains(h, '{d}')" for d in pages.AUTHORITY_DOMAINS)})) AS sources,
  {" + ".join(f"({' OR '.join(f"contains(link_text, '{x}')" for x in names)})::INTEGER" for names in (("privacy",), ("terms", "tos"), ("contact",), ("about",)))} AS trust,
  coalesce(TRY_CAST(dated AS TIMESTAMP) < TIMESTAMP '{AS_OF}' AND TRY_CAST(dated AS TIMESTAMP) > TIMESTAMP '{AS_OF}' - INTERVAL 180 DAY, false) AS fresh FROM md),
g AS (SELECT *, wrote OR (regexp_matches(seen, '(?i)class=["''][^"'']*(author-bio|about-author|author-description|author-info)') AND length(section) > 50) AS bio, works OR (author IS NOT NULL AND {_some("section", pages.CREDENTIALS)}) AS titles FROM f)
SELECT page_id, author, bio AS has_bio, titles AS has_credentials, trust::INTEGER AS trust_pages, sources::INTEGER AS authority_links,
  {_points(("author IS NOT NULL", 20), ("bio", 15), ("titles", 10), ("dated IS NOT NULL", 5), ("fresh", 10), *((f"trust >= {k}", 5) for k in (1, 2, 3, 4)), *_above("sources", (1, 8), (3, 7), (5, 5)))} AS author_score FROM g""")
def p12_author_trust(spark, sf_dir):
    rows = pages.dates_and_author(pages.links_of(pages.with_parts(_marked_up(spark, sf_dir))), _as_of())
    return pages.author_trust(rows).select("page_id", "author", "has_bio", "has_credentials", "trust_pages", "authority_links", "author_score")


def _quality_sql() -> str:
    front = "length(f) > 30 AND NOT starts_with(f, 'In this') AND NOT starts_with(f, 'Here') AND length(string_split_regex(f, '[.!?]')[1]) > 20 AND length(string_split_regex(f, '[.!?]')[1]) < 200"
    pronouns = ", ".join(f"'{w}'" for w in pages.PRONOUNS)
    fillers = "len(regexp_extract_all(lower(text), '" + r"\b(" + "|".join(pages.FILLERS) + r")\b" + "'))"
    return rf"""WITH {_PARTS}, h AS (SELECT *, {_HEADS} AS all_heads, list_transform({_paragraphs('seen')}, lambda t: string_split(lower(t), ' ')) AS paras, list_filter(list_transform(string_split_regex(main, '(?is)<h[23](?:\s[^>]*)?>.*?</h[1-6]>'), lambda x: {_text("regexp_replace(x, '(?i)<(?:p|h1)[\\s>]', ' \\0', 'g')")}), lambda x: x <> '') AS sections, len({_IMAGES}) AS images, {_ALTS} AS alts, len(words) AS n FROM p),
mh AS (SELECT *, list_filter(all_heads, lambda h: h.level <= 4) AS heads FROM h),
q AS (SELECT *, {_MARKED} AS marked, len(list_filter(list_transform(sections, lambda s: array_to_string(string_split(s, ' ')[1:60], ' ')), lambda f: {front})) AS front, len(list_filter(paras, lambda p: len(p) BETWEEN 30 AND 70)) AS concise, list_filter(paras, lambda p: len(p) >= 15) AS long, {fillers} AS fillers,
  len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: length(trim(s)) > 10)) AS sentences, {_matches('text', pages.FACTS)} AS facts, len(list_filter(sections, lambda s: len(string_split(s, ' ')) BETWEEN 50 AND 500)) AS modular FROM mh),
r AS (SELECT *, CASE WHEN len(long) > 0 THEN floor((1 - len(list_filter(long, lambda p: len(list_filter(p, lambda w: w IN ({pronouns}))) / len(p)::DOUBLE > 0.08)) / len(long)::DOUBLE) * 100 + 0.5) ELSE 50 END::BIGINT AS own, floor(greatest(0.0, 1 - CASE WHEN n > 0 THEN fillers / n::DOUBLE ELSE 0 END * 20) * 100 + 0.5)::BIGINT AS fluff, CASE WHEN n > 0 THEN facts / n::DOUBLE * 100 ELSE 0 END AS density,
  len(list_filter(marked, lambda t: {" OR ".join(f"contains(lower(t), '{x}')" for x in pages.TLDR_QUALITY)})) > 0 AS tldr, CASE WHEN images > 0 THEN floor(alts / images::DOUBLE * 100 + 0.5) ELSE 100 END AS alt, floor(greatest(0.0, least(100.0, 100 - (CASE WHEN sentences > 0 THEN n / sentences::DOUBLE ELSE 20 END - 15) * 3)) + 0.5)::BIGINT AS ease FROM q)
SELECT page_id, front::INTEGER AS front_loaded, concise::INTEGER AS concise, own AS self_contained, fluff, density::DOUBLE AS fact_density, modular::INTEGER AS modular, ease AS readability,
  {_points(*_above("front", (1, 5), (3, 5), (5, 5)), *_above("concise", (2, 5), (5, 5)), *_above("own", (70, 5), (85, 5)), *_above("fluff", (70, 5), (85, 5), (95, 5)), *_above("density", (0.5, 5), (1, 5), (2, 5)), ("tldr", 10), *_above("modular", (3, 5), (5, 5)), *_above("alt", (80, 5), (95, 5)), ("ease >= 60", 5))} AS quality_score FROM r"""


@query(_quality_sql())
def p13_content_quality(spark, sf_dir):
    return pages.quality(_parts(spark, sf_dir)).select("page_id", "front_loaded", "concise", "self_contained", "fluff", "fact_density", "modular", "readability", "quality_score")


_TYPES = ("Product", "NewsArticle", "Article", "FAQPage", "LocalBusiness", "Event", "Thing")
_FOLDERS = ("blog", "shop", "services", "about", "contact", "x")


_LONG = "A long description of a page. " * 120


@query(f"""WITH h AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN ([{', '.join(f"'{t}'" for t in _TYPES)}])[page_id % 7 + 1] END AS type,
  CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0) || '/' || CASE WHEN page_id % 5 = 0 THEN '' ELSE ([{', '.join(f"'{t}'" for t in _FOLDERS)}])[page_id % 6 + 1] || '/' || page_id END ELSE '' END AS c FROM pages),
x AS (SELECT page_id, c, json_extract_string(json_object('description', '{_LONG}', 'author', json_object('@type', 'Event'), '@type', type), '$."@type"') AS t FROM h)
SELECT page_id, CASE WHEN t = 'Product' THEN 'product' WHEN t IN ('BlogPosting', 'NewsArticle') THEN 'blog-post' WHEN t = 'Article' THEN 'article' WHEN t = 'FAQPage' THEN 'faq' WHEN t = 'LocalBusiness' THEN 'local-business' WHEN t = 'Event' THEN 'event'
  WHEN regexp_matches(c, '(?i)/(blog|news|post|article)/') THEN 'blog-post' WHEN regexp_matches(c, '(?i)/(product|shop|store)/') THEN 'product' WHEN regexp_matches(c, '(?i)/(service|services)/') THEN 'service'
  WHEN regexp_matches(c, '(?i)/about/') THEN 'about' WHEN regexp_matches(c, '(?i)/contact/') THEN 'contact' WHEN c = '' OR regexp_matches(c, '^[A-Za-z]+://[^/]*/?$') THEN 'homepage' ELSE 'page' END AS page_type FROM x""")
def p14_page_type(spark, sf_dir):
    """The driver's pages name no canonical url and no type: some of each are put before them, by page number; the type stands behind a long text and an object."""
    n = F.col("page_id")
    at = lambda names, k: F.get(F.array(*map(F.lit, names)), (n % k).cast("int"))
    begun = f'<script type="application/ld+json">{{"description": "{_LONG}", "author": {{"@type": "Event"}}, "@type": "'
    block = F.when(n % 3 == 0, F.concat(F.lit(begun), at(_TYPES, 7), F.lit('"}</script>'))).otherwise("")
    path = F.when(n % 5 == 0, "").otherwise(F.concat(at(_FOLDERS, 6), F.lit("/"), n.cast("string")))
    link = F.when(n % 2 == 0, F.concat(F.lit('<link rel="canonical" href="'), F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*", 0), F.lit("/"), path, F.lit('">'))).otherwise("")
    marked = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(block, link, F.coalesce("html", F.lit(""))).alias("html"))
    return json_ld.with_json_ld(marked).select("page_id", pages.page_type(F.col("tree"), F.col("ld")).alias("page_type"))


@query(rf"""WITH {_PARTS}, {_JSON}, {_MARKED_UP}, fq AS (SELECT k, sum(n) AS n FROM (SELECT a.k, json_array_length(a.o, '$.mainEntity') AS n FROM above a WHERE json_extract_string(a.o, '$."@type"') = 'FAQPage' OR EXISTS (SELECT 1 FROM below b WHERE b.k = a.k AND b.pos = a.pos AND json_extract_string(b.o, '$."@type"') = 'FAQPage')) GROUP BY k),
f AS (SELECT page_id, len(regexp_extract_all(seen, '(?i)<(?:[a-z0-9]+\s(?:[^>]*\s)?(?:class=["''][^"'']*(?:faq|accordion)|id=["''][^"'']*faq)|details[\s>]|dt[\s>])')) AS blocks,
  len(list_filter({_HEADS}, lambda h: h.level BETWEEN 2 AND 4 AND (regexp_matches(h.text, '{pages.QUESTION}') OR h.text[-1:] = '?'))) AS asked, fq.k IS NOT NULL AS s, coalesce(fq.n, 0) AS n FROM mp LEFT JOIN fq USING (k))
SELECT page_id, s AS faq_schema, n::INTEGER AS faq_questions, blocks::INTEGER AS qa_blocks, asked::INTEGER AS question_headings,
  {_points(("s", 25), ("s AND n >= 3", 10), ("s AND n >= 5", 5), *_above("blocks", (1, 15), (3, 10), (5, 5)), *_above("asked", (1, 15), (3, 10), (5, 5)))} AS faq_score FROM f""")
def p5_faq(spark, sf_dir):
    return pages.faq(pages.with_parts(_marked_up(spark, sf_dir))).select("page_id", "faq_schema", "faq_questions", "qa_blocks", "question_headings", "faq_score")


@query(rf"""WITH {_PARTS}, r AS (SELECT *, {_ROBOTS} AS robots, regexp_extract_all(html, '(?is)<link\s[^>]*>') AS tags, {_LINKS} AS hrefs FROM p), f AS (SELECT *, len(list_filter(tags, lambda t: regexp_matches(t, '(?i)type=["'']application/rss.xml["'']') AND regexp_matches(t, '(?i)href=["''][^"'']'))) AS rss, len(list_filter(tags, lambda t: regexp_matches(t, '(?i)type=["'']application/atom.xml["'']') AND regexp_matches(t, '(?i)href=["''][^"'']'))) AS atom,
  len(list_filter(hrefs, lambda h: regexp_matches(h, 'sitemap.*\.xml'))) > 0 OR coalesce(regexp_matches(robots, '(?im)^sitemap:\s*\S'), false) AS sitemap, len(list_filter(tags, lambda t: regexp_matches(t, 'href=["''][^"'']*llms(\.txt|-full)'))) > 0 OR len(list_filter(hrefs, lambda h: contains(h, 'llms.txt'))) > 0 AS llms, len(list_filter(tags, lambda t: regexp_matches(t, '(?i)rel=["'']manifest["'']'))) > 0 AS manifest FROM r)
SELECT page_id, rss::INTEGER AS n_rss, atom::INTEGER AS n_atom, sitemap AS has_sitemap, llms AS has_llms_txt, {_points(("rss > 0 OR atom > 0", 25), ("sitemap", 30), ("manifest", 10), ("llms", 25), ("rss > 0 AND atom > 0", 5), ("rss + atom >= 2", 5))} AS feed_score FROM f""")
def p7_feeds(spark, sf_dir):
    return pages.feeds(_parts(spark, sf_dir)).select("page_id", "n_rss", "n_atom", "has_sitemap", "has_llms_txt", "feed_score")


def _sensitivity_sql() -> str:
    density = ", ".join(f"{{'d': {_matches('body_text', (rf'(?i)\b({words})\b',))} / n::DOUBLE, 'k': {-k}, 'name': '{name}', 'asks': [{', '.join(f"'{s}'" for s in signals)}]}}" for k, (name, words, signals) in enumerate(pages.SENSITIVE))
    signals = {
        "namedAuthor": r"""regexp_matches(html, '(?i)rel=["'']author["'']|class=["''][^"'']*(author-name|byline)|itemprop=["'']author')""", "authorCredentials": rf"""regexp_matches(array_to_string(list_transform(regexp_extract_all(seen, '(?is)<[a-z]+[^>]*class=["''][^"'']*author[^"'']*["''][^>]*>(.*?)</(?:div|section|p|span|aside)>', 1), lambda x: {_text("x")}), ''), '{pages.SENSITIVE_CREDENTIALS}')""",
        **{name: " OR ".join("contains(lower(body_text), '" + t.replace("'", "''") + "')" for t in texts) for name, texts in pages.DISCLAIMERS.items()}, "dateModified": r"""regexp_matches(html, '(?i)<meta[^>]*property=["'']article:modified_time|<time[^>]*\sdatetime=')""", "primarySources": "len(outside) >= 3",
    }
    held = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in signals.items())
    return rf"""WITH {_PARTS}, {_OUTSIDE}, w AS (SELECT *, greatest(1, len(string_split(body_text, ' '))) AS n FROM lo), d AS (SELECT *, list_sort(list_filter([{density}], lambda x: x.d > 0.005), 'DESC')[1] AS top, list_filter([{held}], lambda x: x IS NOT NULL) AS held FROM w),
y AS (SELECT *, coalesce(top.d > 0.01, false) AS ymyl FROM d)
SELECT page_id, ymyl AS is_ymyl, CASE WHEN ymyl THEN top.name END AS ymyl_category, CASE WHEN NOT ymyl THEN 'low' WHEN top.d > 0.03 THEN 'high' WHEN top.d > 0.015 THEN 'medium' ELSE 'low' END AS ymyl_confidence, CASE WHEN ymyl THEN array_to_string(list_filter(top.asks, lambda x: NOT list_contains(held, x)), ',') END AS missing,
  CASE WHEN ymyl THEN floor(len(list_filter(top.asks, lambda x: list_contains(held, x))) / len(top.asks)::DOUBLE * 100 + 0.5) ELSE 100 END::BIGINT AS trust_score FROM y"""


@query(_sensitivity_sql())
def p20_sensitivity(spark, sf_dir):
    """P20 and S3."""
    rows = pages.sensitivity(pages.links_of(_parts(spark, sf_dir)))
    return rows.select("page_id", "is_ymyl", "ymyl_category", "ymyl_confidence", F.array_join("missing", ",").alias("missing"), "trust_score")


def _novelty_sql() -> str:
    flags = [" OR ".join(f"regexp_matches(text, '{x}')" for x in patterns) for patterns in pages.NOVELTY.values()]
    visuals = r"""regexp_matches(html, '(?i)<canvas[\s>]|<svg[^>]*class=["''][^"'']*chart|class=["''][^"'']*(chart|graph)|data-chart')"""
    n = " + ".join(f"(CASE WHEN {x} THEN 1 ELSE 0 END)" for x in [*flags, visuals])
    return f"WITH {_PARTS}, n AS (SELECT page_id, {n} AS n_signals FROM p) SELECT page_id, n_signals::INTEGER AS n_signals, ([15, 35, 55, 70, 85, 100])[n_signals + 1]::BIGINT AS gain_score FROM n"


@query(_novelty_sql())
def p22_information_gain(spark, sf_dir):
    return pages.information_gain(_landmarks(spark, sf_dir)).select("page_id", F.size("novelty").alias("n_signals"), "gain_score")


@query(f"WITH {_PARTS}, b AS (SELECT page_id, unnest(list_transform(range(1, len(words)), lambda i: lower(words[i]) || ' ' || lower(words[i + 1]))) AS b FROM p), r AS (SELECT page_id, b FROM b WHERE length(b) > 6 GROUP BY ALL HAVING count(*) >= 2) SELECT p.page_id, coalesce(c.n, 0)::INTEGER AS repeated_pairs, coalesce(floor(c.n / len(words)::DOUBLE * 100 * 100 + 0.5) / 100, 0)::DOUBLE AS pair_density FROM p LEFT JOIN (SELECT page_id, count(*) AS n FROM r GROUP BY page_id) c ON c.page_id = p.page_id")
def p23_repeated_pairs(spark, sf_dir):
    return pages.topical_depth(pages.links_of(_landmarks(spark, sf_dir))).select("page_id", "repeated_pairs", "pair_density")


@query(f"""WITH {_PARTS}, {_OUTSIDE}, h AS (SELECT *, list_transform(list_filter({_HEADS}, lambda h: h.level BETWEEN 2 AND 4 AND length(h.text) > 3), lambda h: lower(h.text)) AS topics, len(words) AS n, (len(hrefs) - len(outside) - other) AS internal FROM lo),
b AS (SELECT page_id, unnest(list_transform(range(1, len(words)), lambda i: lower(words[i]) || ' ' || lower(words[i + 1]))) AS b FROM p), r AS (SELECT page_id, b FROM b WHERE length(b) > 6 GROUP BY ALL HAVING count(*) >= 2), c AS (SELECT page_id, count(*) AS again FROM r GROUP BY page_id),
d AS (SELECT h.*, len(topics) AS k, len(list_distinct(list_filter(flatten(list_transform(topics, lambda t: string_split(t, ' '))), lambda w: length(w) > 3))) AS vocabulary, CASE WHEN n > 0 THEN coalesce(again, 0) / n::DOUBLE * 100 ELSE 0 END AS density, CASE WHEN len(topics) > 0 THEN n / len(topics)::DOUBLE ELSE n::DOUBLE END AS depth FROM h LEFT JOIN c USING (page_id))
SELECT page_id, k::INTEGER AS n_subtopics, vocabulary::INTEGER AS heading_words, internal::INTEGER AS internal_links, floor(depth + 0.5)::BIGINT AS depth_ratio, {_points(*_above("k", (3, 15), (5, 10), (8, 5)), *_above("vocabulary", (10, 10), (20, 5)), *_above("internal", (3, 10), (10, 10)), *_above("density", (0.5, 10), (1, 5)), ("depth BETWEEN 100 AND 500", 15), ("depth >= 50 AND NOT depth BETWEEN 100 AND 500", 5), ("n >= 500", 5))} AS depth_score FROM d""")
def p23_topical_depth(spark, sf_dir):
    return pages.topical_depth(pages.links_of(_landmarks(spark, sf_dir))).select("page_id", "n_subtopics", "heading_words", "internal_links", "depth_ratio", "depth_score")


def _conversational_sql() -> str:
    you = _some("t", (r"(?i)\byou(r|'re|'ll|'ve)?\b",))
    speaks = f"(len(list_filter(paras, lambda t: {_some('t', pages.STARTERS)})) + len(list_filter(paras, lambda t: {you})))"
    return rf"""WITH {_PARTS}, h AS (SELECT *, list_transform(list_filter({_HEADS}, lambda h: h.level <= 4), lambda h: h.text) AS heads, list_filter({_paragraphs('seen')}, lambda t: length(t) >= 30) AS paras FROM p),
r AS (SELECT *, CASE WHEN len(heads) > 0 THEN len(list_filter(heads, lambda t: regexp_matches(t, '(?i)^(what|how|why|when|where|who|which|can|does|is|are|should|could|will)\s') OR t[-1:] = '?')) / len(heads)::DOUBLE ELSE 0 END AS q,
  CASE WHEN len(paras) > 0 THEN least(1.0, {speaks} / len(paras)::DOUBLE) ELSE 0 END AS l, len(list_filter(paras, lambda t: {_some('t', pages.DIRECT)})) AS direct, {_matches('lower(body_text)', pages.QUERY_PHRASES)} AS phrases FROM h)
SELECT page_id, q::DOUBLE AS question_ratio, l::DOUBLE AS language_ratio, direct::INTEGER AS direct_answers, phrases::INTEGER AS query_phrases,
  {_points(*_above("q", (0.1, 5), (0.25, 10), (0.5, 5)), *_above("l", (0.1, 5), (0.2, 10), (0.4, 5)), *_above("direct", (1, 5), (3, 10), (5, 5)), *_above("phrases", (2, 5), (5, 10), (10, 5)), ("l > 0.2 OR q > 0.3 OR " + _some("body_text", (r"(?i)\b(you|your|you're)\b",)), 20))} AS conversation_score FROM r"""


@query(_conversational_sql())
def p24_conversational(spark, sf_dir):
    return pages.conversational(_parts(spark, sf_dir)).select("page_id", "question_ratio", "language_ratio", "direct_answers", "query_phrases", "conversation_score")


@query(rf"WITH r AS (SELECT page_id, url, {_ROBOTS} AS robots FROM pages) SELECT page_id, CASE WHEN page_id % 5 = 0 AND length('key-' || md5(url)) BETWEEN 8 AND 128 THEN 80 WHEN coalesce(regexp_matches(robots, '(?i)indexnow'), false) THEN 20 ELSE 0 END::INTEGER AS indexnow_score FROM r")
def p25_indexnow(spark, sf_dir):
    key = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("key-"), F.md5("url")))
    return _raw(spark, sf_dir).select("page_id", pages.indexnow_score(key, F.col("robots_txt")).alias("indexnow_score"))


@query(f"""WITH {_PARTS}, {_STRUCTURE} SELECT page_id, md5(chr(123) || '"h1_count":' || h1 || ',"list_count":' || lists || ',"table_count":' || tables || ',"word_count":' || word_count || ',"paragraph_count":' || n_paras || ',"n_words":' || len(words) || chr(125)) AS content_hash FROM sa""")
def p26_content_hash(spark, sf_dir):
    """The hash of what is extracted from a page."""
    rows = pages.structure(_parts(spark, sf_dir)).withColumn("n_words", F.size("words"))
    return rows.select("page_id", pages.content_hash(*(F.col(c) for c in ("h1_count", "list_count", "table_count", "word_count", "paragraph_count", "n_words"))).alias("content_hash"))


@query("SELECT s_suppkey AS id, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS norm FROM supplier")
def p29_normal_names(spark, sf_dir):
    from ..functions.exprs import norm_name

    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), norm_name(F.col("s_name")).alias("norm"))


@query("SELECT event_id, ts < TIMESTAMP '2024-01-31' AND ts > TIMESTAMP '2024-01-21' AS recent FROM events")
def p30_freshness(spark, sf_dir):
    from ..functions.exprs import is_recent

    at = F.col("ts")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(at.isNotNull(), is_recent(at, _as_of(), 10)).alias("recent"))


@query(rf"""WITH {_PARTS}, {_JSON}, {_MARKED_UP}, ty AS (SELECT page_id, types, speakable, objects, regexp_matches(html, '(?i)<[^>]*\sitemscope') AS micro FROM mp JOIN kind USING (k))
SELECT page_id, len(types)::INTEGER AS n_types, micro AS has_microdata, speakable AS is_speakable,
  least(100, CASE WHEN len(types) > 0 THEN 20 ELSE 0 END + CASE WHEN len(types) >= 3 THEN 15 ELSE 0 END + least(10 * len(list_filter(types, lambda x: x IN ({', '.join(f"'{v}'" for v in json_ld.VALUABLE)}))), 40)
  + CASE WHEN speakable THEN 10 ELSE 0 END + CASE WHEN objects > 0 THEN 5 ELSE 0 END + CASE WHEN objects > 0 AND micro THEN 5 ELSE 0 END)::BIGINT AS schema_score FROM ty""")
def p2_p3_schema_types(spark, sf_dir):
    rows = json_ld.schema_score(json_ld.with_json_ld(_marked_up(spark, sf_dir)))
    return rows.select("page_id", F.size("schema_types").alias("n_types"), "has_microdata", "is_speakable", "schema_score")


_LATER = f"TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY"
_BAD_DATES = " + ".join(f"(i.{d} IS NOT NULL AND coalesce(TRY_CAST(i.{d} AS TIMESTAMP) > {_LATER}, true))::INTEGER" for d in ("published", "modified", "created"))


@query(f"""WITH {_PARTS}, {_JSON}, {_MARKED_UP}, {_LD},
x AS (SELECT lt.page_id, coalesce(title <> '' AND NOT {_FUZZY("coalesce(i.headline, i.name)", "title")} AND NOT {_FUZZY("coalesce(i.headline, i.name)", "h1")}, false)::INTEGER AS a,
  coalesce(length(i.description) > 10 AND length(about) > 10 AND NOT {_FUZZY("i.description[1:80]", "about[1:80]")}, false)::INTEGER AS d, {_BAD_DATES} AS b, coalesce(length(i.author) > 2 AND NOT contains(body_text, i.author), false)::INTEGER AS c,
  ((i.type = 'Product' AND json_extract(i.o, '$.offers') IS NULL) OR (i.type = 'Article' AND json_extract(i.o, '$.author') IS NULL) OR (i.type IN ('Review', 'AggregateRating') AND json_extract(i.o, '$.reviewRating') IS NULL AND json_extract(i.o, '$.ratingValue') IS NULL))::INTEGER AS f
  FROM lt JOIN item i USING (k)),
y AS (SELECT mp.page_id, any_value(kind.bad)::INTEGER AS e, coalesce(sum(x.a), 0) AS a, coalesce(sum(x.b), 0) AS b, coalesce(sum(x.c), 0) AS c, coalesce(sum(x.d), 0) AS d, coalesce(sum(x.f), 0) AS f FROM mp JOIN kind USING (k) LEFT JOIN x ON x.page_id = mp.page_id GROUP BY mp.page_id)
SELECT page_id, (a + b + c + d + e + f)::INTEGER AS n_issues,
  greatest(0, 100 - CASE WHEN a > 0 THEN 20 ELSE 0 END - CASE WHEN d > 0 THEN 15 ELSE 0 END - CASE WHEN b > 0 THEN 20 ELSE 0 END - CASE WHEN c > 0 THEN 15 ELSE 0 END - least((a + b + c + d + e + f) * 5, 30))::BIGINT AS accuracy_score FROM y""")
def p11_schema_accuracy(spark, sf_dir):
    rows = json_ld.schema_accuracy(json_ld.with_json_ld(pages.with_parts(_marked_up(spark, sf_dir))), _as_of())
    return rows.select("page_id", "n_issues", "accuracy_score")


@query(f"""WITH {_PARTS}, {_JSON}, {_MARKED_UP}, {_LD},
x AS (SELECT lt.page_id, coalesce(length(i.author) > 2 AND NOT contains(lower(text), lower(i.author)), false)::INTEGER + coalesce(h1 <> '' AND NOT {_FUZZY("i.headline", "h1")}, false)::INTEGER AS soft,
  coalesce(TRY_CAST(i.published AS TIMESTAMP) > {_LATER}, false)::INTEGER + coalesce(TRY_CAST(i.modified AS TIMESTAMP) > {_LATER}, false)::INTEGER
  + coalesce(json_extract_string(i.o, '$.aggregateRating.ratingValue')::DOUBLE > coalesce(json_extract_string(i.o, '$.aggregateRating.bestRating')::DOUBLE, 5), false)::INTEGER AS hard FROM lt JOIN item i USING (k) WHERE i.top),
y AS (SELECT mp.page_id, coalesce(sum(soft), 0) AS soft, coalesce(sum(hard), 0) AS hard FROM mp LEFT JOIN x ON x.page_id = mp.page_id GROUP BY mp.page_id)
SELECT page_id, hard::INTEGER AS contradictions, soft::INTEGER AS inconsistencies, greatest(0, 100 - hard * 20 - soft * 10)::BIGINT AS risk_score, CASE WHEN hard >= 2 THEN 'high' WHEN hard >= 1 OR soft >= 3 THEN 'medium' ELSE 'low' END AS risk_level FROM y""")
def p21_hallucination_risk(spark, sf_dir):
    rows = json_ld.hallucination_risk(json_ld.with_json_ld(pages.with_parts(_marked_up(spark, sf_dir), H.LANDMARKS)), _as_of())
    return rows.select("page_id", "contradictions", "inconsistencies", "risk_score", "risk_level")


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


@query(rf"SELECT page_id, CASE WHEN {_HOST} = '' THEN 'invalid' WHEN lower(regexp_extract(url, '^([A-Za-z]+):', 1)) NOT IN ('http', 'https') THEN 'scheme' WHEN regexp_matches({_HOST}, '^(localhost|127\.0\.0\.1|0\.0\.0\.0)$|^10\.|^192\.168\.|\.(local|internal)$') THEN 'private_host' END AS reason FROM pages")
def f1_url_admission(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.url_reject_reason(F.col("url")).alias("reason"))


_NORMAL = r"""lower(regexp_extract({u}, '^([A-Za-z]+://[^/?#]*)', 1)) || CASE WHEN regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' WHEN length(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) > 1 THEN regexp_replace(regexp_extract({u}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/$', '') ELSE '/' END
 || CASE WHEN regexp_extract({u}, '^[^?#]*\?([^#]*)', 1) <> '' THEN '?' || regexp_extract({u}, '^[^?#]*\?([^#]*)', 1) ELSE '' END"""


@query(f"SELECT page_id, {_NORMAL.format(u='url')} AS normal_url FROM pages")
def f2_normal_url(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.normal_url(F.col("url")).alias("normal_url"))


@query(rf"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1)) AS href FROM pages), a AS (SELECT page_id, url, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || href
  WHEN starts_with(href, '#') OR starts_with(href, '?') THEN regexp_replace(url, '[?#].*$', '') || href ELSE regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z]+://[^/]*)$', '\1/'), '[^/]*$', '') || href END AS link FROM h)
SELECT DISTINCT page_id, {_NORMAL.format(u='link')} AS link FROM a WHERE lower(regexp_extract(link, '^[A-Za-z]+://([^/?#:]*)', 1)) = {_HOST} AND NOT regexp_matches(lower(regexp_extract(link, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '\.(jpg|jpeg|png|gif|svg|webp|css|js|pdf|zip|mp3|mp4|woff|woff2|ico)$|/(wp-admin|wp-json|feed)')""")
def f12_page_links(spark, sf_dir):
    return urls.page_links(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query(f"WITH {_VERDICTS} SELECT * FROM verdicts")
def f13_f14_robots(spark, sf_dir):
    return _raw(spark, sf_dir).select("page_id", pages.robots_summary(F.col("robots_txt")).alias("r")).select("page_id", "r.*")


#: Urls of one sitemap at most, as the protocol has it.
SITEMAP_URLS = 50_000


def _sitemaps(spark, sf_dir, most: int = SITEMAP_URLS):
    """Sitemaps of each host's pages, one for each run of ``most`` page numbers."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("site", urls.host_of(F.col("url")))
    entry = F.concat(F.lit("<url><loc>"), "url", F.lit("</loc>"), F.when(F.col("page_id") % 2 == 0, "<priority>0.8</priority>").when(F.col("page_id") % 3 == 0, "<priority>abc</priority>").otherwise(""), F.lit("</url>"))
    return rows.groupBy("site", F.floor(F.col("page_id") / most).alias("run")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", entry.alias("e")))), lambda x: x["e"]), "").alias("xml")).withColumn("sitemap_url", F.concat(F.lit("https://"), "site", F.when(F.col("run") == 0, "/sitemap.xml").otherwise(F.concat(F.lit("/sitemap-"), F.col("run").cast("string"), F.lit(".xml"))))).drop("run")


_ENTRIES = rf"""en AS (SELECT {_HOST} AS site, page_id // {SITEMAP_URLS} AS run, page_id, url, CASE WHEN page_id % 2 = 0 THEN 0.8 ELSE 0.5 END::DOUBLE AS priority FROM pages),
maps AS (SELECT site, 'https://' || site || CASE WHEN run = 0 THEN '/sitemap.xml' ELSE '/sitemap-' || run || '.xml' END AS sitemap_url, (row_number() OVER (PARTITION BY site, run ORDER BY page_id) - 1)::INTEGER AS ord, url, priority, run FROM en)"""


@query(f"WITH {_ENTRIES} SELECT site, sitemap_url, ord, url, priority FROM maps")
def io4_sitemap_urls(spark, sf_dir):
    return readers.sitemap_urls(_sitemaps(spark, sf_dir))


@query(f"WITH {_ENTRIES} SELECT site, ord, url AS child_url FROM maps")
def io5_child_sitemaps(spark, sf_dir):
    index = _sitemaps(spark, sf_dir).withColumn("xml", F.replace(F.replace("xml", F.lit("<url>"), F.lit("<sitemap>")), F.lit("</url>"), F.lit("</sitemap>")))
    return readers.child_sitemaps(index, None)


@query(rf"WITH r AS (SELECT page_id, {_ROBOTS} AS robots FROM pages) SELECT page_id, trim(unnest(regexp_extract_all(robots, '(?im)^sitemap:[ \t]*(\S[^\r\n]*)$', 1))) AS sitemap_url FROM r")
def io6_robots_sitemaps(spark, sf_dir):
    return _raw(spark, sf_dir).select("page_id", F.explode(readers.robots_sitemaps(F.col("robots_txt"))).alias("sitemap_url"))


@query("""SELECT page_id, CASE WHEN page_id % 23 = 0 THEN 'redirect_not_followed' WHEN page_id % 19 = 0 THEN 'http_error' WHEN page_id % 17 = 0 THEN 'not_html' WHEN length(html) > 5242880 THEN 'too_large' END AS reject_reason FROM pages""")
def io3_page_admission(spark, sf_dir):
    return readers.admitted(_raw(spark, sf_dir)).select("page_id", "reject_reason")


@query("SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_linenumber % 3 = 0 OR l_returnflag = 'R' THEN 0 ELSE 1 END AS n_fixes FROM lineitem")
def io7_stored_fixes(spark, sf_dir):
    """Fixes written as JSON, some without a number of points or with a layer that is none."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    fix = F.to_json(F.array(F.struct(F.lit("text").alias("description"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber")).alias("points"), F.when(F.col("l_returnflag") == "R", "other").otherwise("access").alias("layer"), F.lit("1.1").alias("factorId"), F.lit(1).alias("priority"))))
    return t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.size(readers.parsed_fixes(fix)).alias("n_fixes"))


_STORED = (
    '{"feed": 40, "schema": 12.5, "new": 7}', '{"feed": "40", "allowsGPTBot": true, "exists": false, "note": null}', "{broken", "[1, 2]", '{"nested": {"feed": 1}, "list": [1], "access": 3, "hasSitemap": true}', "null",
)


@query(f"""WITH t(k, b) AS (VALUES {', '.join(f"({k}, '{b}')" for k, b in enumerate(_STORED))}),
v AS (SELECT k, j.key, j.type, j.atom FROM (SELECT k, b::JSON AS b FROM t WHERE json_valid(b) AND json_type(b) = 'OBJECT') x, json_each(x.b) j),
f AS (SELECT t.k, count(*) FILTER (type IN ('UBIGINT', 'BIGINT', 'DOUBLE')) AS n_scores, coalesce(sum(CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN atom::VARCHAR::DOUBLE END), 0) AS total,
  coalesce(string_agg(key || '=' || atom::VARCHAR, ',' ORDER BY key) FILTER (type = 'BOOLEAN'), '') AS flags FROM t LEFT JOIN v ON v.k = t.k GROUP BY t.k)
SELECT event_id AS id, n_scores::INTEGER AS n_scores, total::DOUBLE AS total, flags FROM events JOIN f ON f.k = event_id % {len(_STORED)}""")
def io7_stored_scores(spark, sf_dir):
    """Stored JSON of scans, by their number: scores, flags, texts, arrays and what is no JSON."""
    text = F.get(F.array(*map(F.lit, _STORED)), (F.col("event_id") % len(_STORED)).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), readers.parsed_scores(text).alias("scores"), readers.parsed_flags(text).alias("flags"))
    flags = F.transform(F.array_sort(F.map_entries("flags")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return rows.select("id", F.size("scores").alias("n_scores"), F.aggregate(F.map_values("scores"), F.lit(0.0), lambda s, x: s + x).alias("total"), F.array_join(flags, ",").alias("flags"))


@query(rf"""WITH {_ENTRIES}, links AS ({ORACLE["f12_page_links"]}), c AS (SELECT DISTINCT site, 'https://' || site || '/' AS url, 0 AS rank, 'homepage' AS source, 1.0::DOUBLE AS priority, 0 AS ord FROM en
  UNION ALL SELECT site, {_NORMAL.format(u='url')}, 1, 'sitemap', priority, run * {SITEMAP_URLS} + ord FROM maps UNION ALL SELECT {_HOST}, l.link, 2, 'link', 0.3, p.page_id FROM links l JOIN pages p USING (page_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY rank, ord, source, priority) AS k FROM c), o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority DESC, rank, ord, url)::INTEGER AS position FROM f WHERE k = 1)
SELECT site, url, source, priority, position FROM o WHERE position <= 100""")
def s1_l4_discovered_pages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("site", urls.host_of(F.col("url")))
    home = rows.select("site").distinct().select("site", F.concat(F.lit("https://"), "site", F.lit("/")).alias("url"), F.lit(0).cast("long").alias("ord"))
    maps = readers.sitemap_urls(_sitemaps(spark, sf_dir)).select("site", "url", (F.coalesce(F.regexp_extract("sitemap_url", r"/sitemap-(\d+)\.xml$", 1).try_cast("long"), F.lit(0)) * SITEMAP_URLS + F.col("ord")).alias("ord"), "priority")
    links = urls.page_links(rows).join(rows.select("page_id", "site"), "page_id").select("site", F.col("link").alias("url"), F.col("page_id").alias("ord"))
    return urls.discovered(home, maps, links)


def _site_names(rows):
    """Pages of their host, with names taken from their numbers."""
    n = F.col("page_id")
    org = F.when(n % 3 == 0, F.concat(F.lit("Acme "), (n % 7).cast("string"), F.lit(" Inc"))).when(n % 3 == 1, F.concat(F.lit("ACME, "), (n % 7).cast("string"), F.lit(" Inc."))).otherwise(F.concat(F.lit("Beta "), (n % 5).cast("string")))
    author = F.when(n % 4 == 0, "Ann Lee").when(n % 4 == 1, "ann lee").otherwise(F.concat(F.lit("Writer "), (n % 11).cast("string")))
    url = F.concat("url", F.lit("#"), n.cast("string"))
    return rows.select(urls.host_of(F.col("url")).alias("site"), url.alias("url"), F.array(org).alias("organization_names"), F.array(author).alias("author_names"), *(c for c in ("top_entities",) if c in rows.columns))


def _site_entities(spark, sf_dir):
    """As ``_site_names``, with the entities of each page's whole text, which are found once."""
    rows = pages.entities(_parts(spark, sf_dir)).select("page_id", "url", F.array_union("names", "long_names").alias("top_entities"))
    return _site_names(stored(rows, "page-entities"))


_SITES = rf"""{_PARTS}, {_RUNS}, e AS (SELECT {_HOST} AS site, url || '#' || page_id AS url, CASE page_id % 3 WHEN 0 THEN 'Acme ' || (page_id % 7) || ' Inc' WHEN 1 THEN 'ACME, ' || (page_id % 7) || ' Inc.' ELSE 'Beta ' || (page_id % 5) END AS org,
  CASE page_id % 4 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'ann lee' ELSE 'Writer ' || (page_id % 11) END AS author, list_concat(single, multi) AS top FROM names)"""


def _variants(name: str) -> str:
    """The name variants of each site, after ``e``."""
    return rf"""SELECT DISTINCT a.site, a.name FROM d_{name} a JOIN d_{name} b ON a.site = b.site AND a.norm = b.norm AND a.name <> b.name
UNION SELECT a.site, min(a.name) FROM d_{name} a JOIN (SELECT DISTINCT site, norm FROM d_{name}) b ON a.site = b.site AND a.norm <> b.norm AND (contains(a.norm, b.norm) OR contains(b.norm, a.norm)) GROUP BY a.site, a.norm"""


def _distinct(name: str) -> str:
    return f"d_{name} AS (SELECT DISTINCT site, {name} AS name, {_NORM.format(x=name)} AS norm FROM e)"


_OVERLAP = rf"""w AS (SELECT site, url, list_distinct(list_transform(top, lambda x: {_NORM.format(x='x')})) AS own FROM e),
j AS (SELECT a.site, len(list_intersect(a.own, b.own)) AS i, len(a.own) + len(b.own) AS two FROM w a JOIN w b ON a.site = b.site AND a.url < b.url),
overlap AS (SELECT n.site, n.pages, coalesce(floor(avg(CASE WHEN two > 0 THEN i / (two - i)::DOUBLE END) * 100 + 0.5), 50)::BIGINT AS overlap FROM (SELECT site, count(*) AS pages FROM w GROUP BY site) n LEFT JOIN j USING (site) GROUP BY n.site, n.pages)"""


@query(f"WITH {_SITES}, {_distinct('org')} {_variants('org')}")
def j12_name_variants(spark, sf_dir):
    return entities.name_variants(_site_names(spark.read.parquet(f"{sf_dir}/pages.parquet")), "organization_names")


@query(f"WITH {_SITES}, {_distinct('org')}, v AS ({_variants('org')}) SELECT DISTINCT e.site, e.url FROM e JOIN v ON e.site = v.site AND (contains({_NORM.format(x='e.org')}, {_NORM.format(x='v.name')}) OR contains({_NORM.format(x='v.name')}, {_NORM.format(x='e.org')}))")
def j13_affected_pages(spark, sf_dir):
    rows = _site_names(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return entities.affected_pages(rows, entities.name_variants(rows, "organization_names"), "organization_names")


@query(f"WITH {_SITES}, {_OVERLAP} SELECT * FROM overlap")
def j14_entity_overlap(spark, sf_dir):
    return entities.entity_overlap(_site_entities(spark, sf_dir))


@query(f"""WITH {_SITES}, {_OVERLAP}, {_distinct('org')}, {_distinct('author')}, vo AS ({_variants('org')}), va AS ({_variants('author')}),
c AS (SELECT *, (SELECT count(*) FROM vo WHERE vo.site = o.site) AS n_org, (SELECT count(*) FROM va WHERE va.site = o.site) AS n_author FROM overlap o),
k AS (SELECT site, pages, CASE WHEN pages <= 1 OR n_org <= 1 THEN 100 ELSE greatest(0, 100 - n_org * 20) END::BIGINT AS a, CASE WHEN pages <= 1 OR n_author <= 1 THEN 100 ELSE greatest(0, 100 - n_author * 15) END::BIGINT AS b, CASE WHEN pages <= 1 THEN 100 ELSE overlap END::BIGINT AS x FROM c)
SELECT site, pages, a AS organization_consistency, b AS author_consistency, x AS entity_overlap, floor(a * 0.35::DOUBLE + b * 0.30::DOUBLE + x * 0.35::DOUBLE + 0.5)::BIGINT AS score FROM k""")
def a22_site_consistency(spark, sf_dir):
    return entities.site_consistency(_site_entities(spark, sf_dir))


@query(rf"""WITH h AS (SELECT DISTINCT {_HOST} AS domain FROM pages), n AS (SELECT domain, ('0x' || substr(md5(domain), 1, 7))::BIGINT AS n FROM h),
c AS (SELECT domain, n % 101 AS authority, TIMESTAMP '{AS_OF}' - to_days((n % 60)::INTEGER) + INTERVAL 30 DAY AS expires_at FROM n WHERE n % 3 <> 0)
SELECT h.domain, c.authority, c.expires_at, c.expires_at IS NULL AS refresh FROM h LEFT JOIN c ON c.domain = h.domain AND c.expires_at >= TIMESTAMP '{AS_OF}'""")
def j10_authority_cache(spark, sf_dir):
    """Authority of each page's host, cached for 30 days; what is missing or expired is to be refreshed."""
    from ..operators.cache import cached_authority

    hosts = spark.read.parquet(f"{sf_dir}/pages.parquet").select(urls.host_of(F.col("url")).alias("domain")).distinct()
    cache = hosts.withColumn("n", F.conv(F.substring(F.md5("domain"), 1, 7), 16, 10).cast("long")).where("n % 3 <> 0").select("domain", (F.col("n") % 101).alias("authority"), F.timestamp_add("DAY", -(F.col("n") % 60).cast("int"), _as_of()).alias("fetched_at"))
    return cached_authority(hosts, cache, _as_of())
