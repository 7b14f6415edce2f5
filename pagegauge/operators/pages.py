"""Page analyzers: each adds facts and a score, all from columns of one row; nothing is shuffled.

Input rows have ``html`` and, where asked for, ``url``, ``robots_txt`` and ``ttfb_ms``. ``with_parts`` cuts the page once; the
analyzers read its parts. An array of one element that is transformed binds a costly expression to a variable, so that it is
evaluated once and not in each place that uses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import json_ld as J
from ..functions import tree as T
from ..functions.exprs import is_recent, js_round
from .urls import host_of, path_of, query_of, scheme_of

QUESTION = r"(?i)^(what|who|where|when|why|how|is|are|can|do|does|should|will|would)\s"
# Words that say little, signs of facts, statistics and definitions, and names of trust.
FILLERS = (
    "actually", "basically", "clearly", "definitely", "essentially", "honestly", "hopefully", "importantly", "interestingly", "literally", "naturally", "obviously", "really", "simply", "surely", "totally",
    "truly", "very", "absolutely", "certainly", "quite", "rather", "somewhat", "pretty much", "kind of", "sort of", "in order to", "it is important to note", "needless to say", "it goes without saying",
    "at the end of the day", "when all is said and done",
)
FACTS = (r"\d+(\.\d+)?%", r"\$[\d,]+", r"\d{4}", r"(?i)\b(study|research|survey|report|analysis)\b", r"(?i)\b(according to|published in|found that|showed that)\b", r"(?i)\b(increase|decrease|growth|decline|rose|fell)\s+\w*\s*\d", r"(?i)\d+\s*(million|billion|thousand|hundred)")
STATISTICS = (r"\d+(\.\d+)?%", r"\$[\d,]+(\.\d+)?", r"\d{1,3}(,\d{3})+", r"(?i)\d+(\.\d+)?\s*(million|billion|trillion)", r"(?i)\d+x\s", r"(?i)(study|research|survey|report|data)\s+(shows?|finds?|found|reveals?|indicates?)", r"(?i)according to")
DEFINITIONS = (r"(?i)\bis\s+(a|an|the)\s+", r"(?i)\brefers?\s+to\b", r"(?i)\bis\s+defined\s+as\b", r"(?i)\bmeans?\s+that\b", r"(?i)\bknown\s+as\b")
PRONOUNS = ("he", "she", "it", "they", "this", "that", "these", "those", "them", "its")
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "need", "dare",
    "ought", "used", "to", "of", "in", "for", "on", "with", "at", "by", "from", "about", "as", "into", "through", "during", "before", "after", "above", "below", "between", "but", "and", "or", "nor",
    "not", "so", "yet", "this", "that", "these", "those", "it", "its", "they", "them", "their", "we", "our", "you", "your", "he", "she", "him", "her", "his", "i", "me", "my", "january", "february",
    "march", "april", "june", "july", "august", "september", "october", "november", "december", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "if", "then", "else",
    "when", "up", "down", "out", "off", "over", "under", "again", "further", "once", "here", "there", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "only",
    "own", "same", "than", "too", "very", "just", "because", "how", "what", "which", "who", "whom", "why", "where",
)
NOVELTY = {
    "Original research detected": (r"(?i)\b(our (study|research|survey|analysis|data|findings))\b", r"(?i)\b(we (found|discovered|analyzed|surveyed|tested|measured))\b", r"(?i)\b(proprietary|exclusive|original research|our methodology)\b", r"(?i)\b(internal data|our database|based on \d[\d,]+ (responses|data points|samples))\b"),
    "Proprietary data references": (r"(?i)\b(our (data|dataset|database))\b", r"(?i)\b(proprietary|exclusive|internal)\s+(data|research|analysis)\b", r"(?i)\b(based on|analyzed)\s+[\d,]+\s+(data points|responses|entries|records)\b"),
    "First-hand experience language": (r"(?i)\b(i (tested|tried|used|experienced|reviewed|built|created))\b", r"(?i)\b(we (tested|tried|used|experienced|reviewed|built|created))\b", r"(?i)\b(hands-on|first-hand|in my experience|from our experience)\b", r"(?i)\b(personal(ly)?|real-world (test|example|experience))\b"),
    "Unique/contrarian insights": (r"(?i)\b(however|contrary to|unlike|what most .+ miss|overlooked)\b", r"(?i)\b(counterintuitive|surprising(ly)?|unexpected(ly)?)\b", r"(?i)\b(key (insight|takeaway|finding)|the real (reason|problem|solution))\b", r"(?i)\b(myth|misconception|commonly (believed|assumed))\b"),
}
# What a text with a match of each of these patterns holds one of, in lower case.
NOVELTY_NEEDS = {
    "Original research detected": (tuple(f"our {x}" for x in ("study", "research", "survey", "analysis", "data", "findings")), tuple(f"we {x}" for x in ("found", "discovered", "analyzed", "surveyed", "tested", "measured")), ("proprietary", "exclusive", "original research", "our methodology"), ("internal data", "our database", "based on ")),
    "Proprietary data references": (("our data",), ("proprietary", "exclusive", "internal"), ("based on", "analyzed")),
    "First-hand experience language": (*(tuple(f"{who} {x}" for x in ("tested", "tried", "used", "experienced", "reviewed", "built", "created")) for who in ("i", "we")), ("hands-on", "first-hand", "in my experience", "from our experience"), ("personal", "real-world ")),
    "Unique/contrarian insights": (("however", "contrary to", "unlike", "what most ", "overlooked"), ("counterintuitive", "surprising", "unexpected"), ("key insight", "key takeaway", "key finding", "the real "), ("myth", "misconception", "commonly ")),
}
SENSITIVE = (
    ("health-medical", "health|medical|disease|symptom|treatment|diagnosis|medication|drug|prescription|hospital|doctor|surgery|cancer|diabetes|heart|blood pressure|mental health|therapy|dosage|side effect", ("namedAuthor", "authorCredentials", "medicalDisclaimer", "dateModified", "primarySources")),
    ("financial", "invest|stock|loan|mortgage|credit|debt|tax|insurance|retirement|401k|ira|banking|financial|money|income|salary|budget|cryptocurrency|trading", ("namedAuthor", "authorCredentials", "financialDisclaimer", "dateModified", "primarySources")),
    ("legal", "law|legal|attorney|lawyer|court|lawsuit|regulation|compliance|rights|liability|contract|patent|copyright|trademark", ("namedAuthor", "authorCredentials", "legalDisclaimer", "dateModified")),
    ("safety", "safety|emergency|danger|hazard|toxic|poison|fire|flood|earthquake|evacuation|first aid|CPR|rescue", ("namedAuthor", "primarySources", "dateModified")),
    ("news-current-events", "breaking news|election|government|policy|legislation|vote|political|democracy|conflict|war", ("namedAuthor", "dateModified", "primarySources", "corrections")),
)
DISCLAIMERS = {
    "medicalDisclaimer": ("medical disclaimer", "not medical advice", "consult your doctor", "consult a healthcare"), "financialDisclaimer": ("financial disclaimer", "not financial advice", "consult a financial advisor"),
    "legalDisclaimer": ("legal disclaimer", "not legal advice", "consult an attorney"), "corrections": ("correction", "update:", "editor's note"),
}
CREDENTIALS = (r"(?i)\b(ph\.?d|m\.?d|m\.?s|m\.?b\.?a|j\.?d|cpa|cfa|rn)\b", r"(?i)\b(professor|doctor|dr\.|certified|licensed|registered)\b", r"(?i)\b(expert|specialist|consultant|analyst|researcher)\b", r"(?i)\b(\d+\+?\s+years?\s+(of\s+)?experience)\b")
SENSITIVE_CREDENTIALS = r"(?i)\b(ph\.?d|m\.?d|m\.?s|certified|licensed|professor|doctor|dr\.)\b"
AUTHORITY_DOMAINS = ("wikipedia.org", "gov", "edu", "who.int", "nih.gov", "cdc.gov", "nature.com", "sciencedirect.com", "pubmed", "ncbi.nlm.nih.gov", "reuters.com", "apnews.com", "bbc.com", "nytimes.com", "wsj.com", "forbes.com", "harvard.edu", "mit.edu", "stanford.edu")
QUERY_PHRASES = (r"how to \w+", r"what is \w+", r"best \w+ for", r"\w+ vs\.? \w+", r"step[- ]by[- ]step", "pros and cons", "compared to", "alternatives to")
STARTERS = (r"(?i)^(here's|here is|the answer|in short|simply put|to put it simply)", r"(?i)^(let me explain|think of it|imagine|for example|consider)", r"(?i)^(the (best|easiest|quickest|simplest|most) way)", r"(?i)^(you can|you should|you'll need|you might|first,)")
DIRECT = (r"^[A-Z][^.!?]{10,80}[.]", r"(?i)^(yes|no)[,.]?\s", r"(?i)^(the answer is|it (is|means|refers to|depends))", r"^\d+[\s.]")
TLDR_SUMMARY = ("tl;dr", "tldr", "summary", "key takeaway", "executive summary", "in brief", "at a glance")
TLDR_QUALITY = ("tl;dr", "key takeaway", "summary", "at a glance", "in brief", "bottom line")


def edged(pattern: str) -> str:
    """A published pattern for Java, whose ``\\b`` asks for Unicode letters: the edge of an ASCII word, either way round."""
    return pattern.replace(r"\b", "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def _tree() -> Column:
    return F.col("tree")


def _any(text: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(edged(p))
    return out


def _holds(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def _count(text: Column, patterns) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + F.regexp_count(text, F.lit(edged(p)))
    return out


def _score(*rules: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for holds, points in rules:
        total = total + F.when(holds, points).otherwise(0)
    return F.least(F.lit(100), total).cast("long")


def _steps(x: Column, *steps: tuple[float, int]) -> list[tuple[Column, int]]:
    return [(x >= least, points) for least, points in steps]


def with_parts(pages: DataFrame, containers: tuple[str, ...] = H.CONTAINERS) -> DataFrame:
    """``tree`` (tags, texts and elements), ``ld`` (facts of its JSON-LD), ``seen`` (the page without scripts), ``main`` (its container, an element), ``text`` (of the
    container), ``words``, ``body_text``.

    Information gain, topical depth and hallucination risk look for the container among ``H.LANDMARKS`` only.
    """
    rows = pages.withColumns({"tree": T.parsed_column("html"), "seen": H.visible(F.col("html"))}).withColumn("ld", J.facts_column("tree"))
    rows = rows.withColumns({"main": T.once(_tree(), lambda t: H.container(t, containers)), "body_text": T.once(_tree(), lambda t: T.once(H.body(t), lambda e: T.text_of(t, e)))})
    return rows.withColumn("text", T.text_of(_tree(), F.col("main"))).withColumn("words", H.words_of(F.col("text")))


def text_facts(pages: DataFrame) -> DataFrame:
    """Words and sentences of the container."""
    sentences = F.filter(F.split("text", "[.!?]+"), lambda s: F.length(F.trim(s)) > 0)
    return pages.withColumns({"n_words": F.size("words"), "n_sentences": F.size(sentences)})


def structure(pages: DataFrame) -> DataFrame:
    """P4."""
    rows = pages.withColumn("headings", H.headings(_tree())).withColumn("paras", F.filter(H.paragraphs(_tree()), lambda p: F.length(p) > 20))
    n = F.size("headings")
    jumps = F.exists(F.zip_with(F.slice("headings", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("headings", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: b["level"] > a["level"] + 1), lambda x: x)
    h1 = F.size(F.filter("headings", lambda h: h["level"] == 1))
    sizes = F.transform("paras", lambda p: F.size(F.split(p, " ")))
    total = F.aggregate(sizes, F.lit(0), lambda s, x: s + x)
    rows = rows.withColumns({"h1_count": h1, "hierarchy_valid": ~jumps & (h1 == 1), "list_count": F.size(T.of_name(_tree(), "ul", "ol")), "table_count": F.size(T.of_name(_tree(), "table")), "word_count": total, "paragraph_count": F.size("paras")})
    rows = rows.withColumn("avg_paragraph", F.when(F.col("paragraph_count") > 0, js_round(F.col("word_count") / F.col("paragraph_count"))).otherwise(F.lit(0).cast("long")))
    level = lambda k: F.exists("headings", lambda h: h["level"] == k)
    avg = F.col("avg_paragraph")
    score = _score(
        (n > 0, 10), (F.col("hierarchy_valid"), 15), (F.col("h1_count") == 1, 5), (level(2), 10), (level(3), 5), *_steps(F.col("list_count"), (1, 10), (3, 5)), (F.col("table_count") > 0, 10),
        *_steps(F.col("word_count"), (300, 5), (800, 5), (1500, 5)), ((avg > 0) & (avg <= 80), 10), ((avg > 0) & (avg <= 50), 5),
    )
    return rows.withColumn("structure_score", score).drop("paras")


def summaries(pages: DataFrame) -> DataFrame:
    """P6."""
    paras = H.paragraphs(_tree(), F.col("main"))
    rows = pages.withColumns({"meta_description": H.meta(_tree(), "name", "description"), "og_description": H.meta(_tree(), "property", "og:description"), "paras": paras})
    opening = F.get(F.filter("paras", lambda p: F.length(p) >= 50), F.lit(0))
    first = F.slice(F.filter("paras", lambda p: F.length(p) >= 30), 1, 3)
    marked = F.concat(F.transform(H.headings(_tree()), lambda h: h["text"]), H.texts_of(_tree(), "strong", "b"))
    rows = rows.withColumns({
        "meta_description_length": F.coalesce(F.length("meta_description"), F.lit(0)), "opening_words": F.coalesce(F.size(F.split(opening, " ")), F.lit(0)),
        "has_opening": opening.isNotNull(), "has_definition": F.exists(first, lambda p: _any(p, DEFINITIONS)), "has_tldr": F.exists(marked, lambda t: _holds(F.lower(t), TLDR_SUMMARY)),
    })
    n, w = F.col("meta_description_length"), F.col("opening_words")
    w = F.when(F.col("has_opening"), w).otherwise(0)
    score = _score(
        (n > 0, 10), (n.between(120, 160), 15), ((n >= 70) & ~n.between(120, 160), 8), (F.length(F.col("og_description")) > 0, 10), (F.col("has_opening"), 10), (w.between(30, 80), 15), ((w >= 20) & ~w.between(30, 80), 8),
        (F.col("has_definition"), 20), (F.col("has_tldr"), 20),
    )
    return rows.withColumn("opening_words", w).withColumn("summary_score", score).drop("paras")


def entities(pages: DataFrame) -> DataFrame:
    """Distinct capitalised words that do not begin a sentence, runs of them, and their density."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    inner = T.once(_tree(), lambda t: T.text_without(t, F.col("main"), "nav", "footer", "header"))
    sentences = F.transform(F.split("entity_text", "[.!?]+"), lambda s: H.words_of(F.trim(s)))
    named = lambda w: w.rlike("^[A-Z][a-z]+") & ~F.array_contains(stop, F.lower(w))
    # a word that is no name becomes a break; what begins a sentence is left out
    marked = F.transform(sentences, lambda s: F.transform(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), lambda w: F.when(named(w), w).otherwise("\u0001")))
    runs = F.flatten(F.transform(marked, lambda s: F.split(F.array_join(s, " "), "\u0001")))
    runs = F.filter(F.transform(runs, lambda r: F.trim(r)), lambda r: r != "")
    rows = pages.withColumn("entity_text", inner).withColumn("runs", runs)
    single = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.split(r, " "))))
    multi = F.array_distinct(F.filter("runs", lambda r: F.contains(r, F.lit(" "))))
    rows = rows.withColumns({"names": single, "long_names": multi}).withColumns({"entity_count": F.size(F.array_union("names", "long_names")), "entity_words": F.size(H.words_of(F.col("entity_text")))})
    density = F.when(F.col("entity_words") > 0, F.col("entity_count") / F.col("entity_words") * 100).otherwise(0.0)
    author = F.exists(H.elements_with(_tree(), "author", lambda t: (H.attribute(t, "rel") == "author") | F.contains(H.attribute(t, "class"), F.lit("author"))), lambda e: F.lit(True)) | F.exists(H.elements_with(_tree(), "byline", lambda t: H.has_class(t, "byline")), lambda e: F.lit(True))
    org = F.exists("ld.items", lambda i: i["top"] & i["type"].isin("Organization", "Corporation"))
    score = _score(*_steps(density, (1, 15), (2, 15), (3, 10)), *_steps(F.col("entity_count"), (5, 10), (10, 10), (20, 5)), *_steps(F.size("long_names"), (2, 10), (5, 5)), (author, 10), (org, 10))
    return rows.withColumns({"entity_density": js_round(density * 100) / 100, "entity_score": score}).drop("entity_text", "runs")


def access(pages: DataFrame, robots: str | None = "robots_txt") -> DataFrame:
    """How well a page can be reached; robots.txt and the time to the first byte count where they are known."""
    url = F.col("url")
    links = H.tags(_tree(), "link")
    rows = pages.withColumns({
        "is_https": scheme_of(url) == "https", "has_canonical": F.exists(links, lambda t: (F.lower(H.attribute(t, "rel")) == "canonical") & H.attribute(t, "href").isNotNull()),
        "is_indexable": ~F.coalesce(F.contains(F.lower(H.meta(_tree(), "name", "robots")), F.lit("noindex")), F.lit(False)), "has_hreflang": F.exists(links, lambda t: H.attribute(t, "hreflang").isNotNull()),
        "clean_url": (query_of(url) == "") | (F.size(F.split(query_of(url), "&")) <= 2),
    })
    n, scripts = F.length("body_text"), H.count_tags(F.col("html"), "script")
    spa = ((n < 100) & (scripts > 3)) | (F.col("html").rlike(r"""(?i)id=["'](root|app)["']""") & (n < 200)) | F.col("html").rlike(r"(?i)data-reactroot")
    rows = rows.withColumn("is_spa", spa)
    points = [(F.col("is_https"), 15), (F.col("has_canonical"), 15), (F.col("is_indexable"), 15), (F.col("clean_url"), 10), (F.col("has_hreflang"), 5), (~F.col("is_spa"), 10)]
    if robots:
        known = F.col(robots).isNotNull()
        verdict = robots_summary(F.col(robots))
        points += [(known & verdict["exists"], 5), *((known & verdict["exists"] & verdict[b], 5) for b in ("googlebot", "gptbot", "claudebot"))]
    if "ttfb_ms" in pages.columns:
        t = F.col("ttfb_ms")
        points += [(t < 200, 10), ((t >= 200) & (t < 500), 7), ((t >= 500) & (t < 1000), 3)]
    return rows.withColumn("access_score", _score(*points))


def bot_allowed(robots: Column, bot: str) -> Column:
    """a fold over the lines of a robots.txt; every User-agent line begins a section, the last rule for "/" in one that applies wins."""
    zero = F.struct(F.lit(False).alias("inside"), F.lit(True).alias("allowed"))

    def step(s: Column, raw: Column) -> Column:
        line = F.trim(F.regexp_replace(raw, r"\s+$", ""))
        agent = F.lower(F.trim(F.regexp_replace(line, r"(?i)^user-agent:\s*", "")))
        names = line.rlike("(?i)^user-agent:")
        inside = F.when(names, agent.isin("*", bot.lower())).otherwise(s["inside"])
        rule = F.when(names | ~s["inside"], s["allowed"]).when(line.rlike(r"(?i)^disallow:\s*/$"), False).when(line.rlike(r"(?i)^allow:\s*/$"), True).otherwise(s["allowed"])
        return F.struct(inside.alias("inside"), rule.alias("allowed"))

    return F.aggregate(F.split(F.coalesce(robots, F.lit("")), "\n"), zero, step, lambda s: s["allowed"])


def robots_summary(robots: Column) -> Column:
    """struct of exists, four verdicts, whether it names a sitemap, and the crawl delay."""
    exists = F.length(F.trim(F.coalesce(robots, F.lit("")))) > 0
    verdicts = [bot_allowed(robots, b).alias(b.lower()) for b in ("Googlebot", "GPTBot", "ClaudeBot", "PerplexityBot")]
    delay = F.regexp_extract(robots, r"(?im)^crawl-delay:\s*(\d+)", 1)
    return F.struct(exists.alias("exists"), *verdicts, F.coalesce(robots.rlike(r"(?im)^\s*sitemap:"), F.lit(False)).alias("has_sitemap"), F.when(delay != "", delay).try_cast("int").alias("crawl_delay"))


def links_of(pages: DataFrame) -> DataFrame:
    """``external_hosts`` and ``internal_links`` of a page, from the a elements."""
    hrefs = F.filter(F.transform(H.tags(_tree(), "a"), lambda t: H.attribute(t, "href")), lambda h: h.isNotNull())
    absolute = F.filter("hrefs", lambda h: h.rlike(r"(?i)^(https?:)?//[^/]"))
    hosts = F.transform(absolute, lambda h: host_of(F.when(F.startswith(h, F.lit("//")), F.concat(F.lit("http:"), h)).otherwise(h)))
    rows = pages.withColumn("hrefs", hrefs).withColumn("link_hosts", hosts).withColumn("host", host_of(F.col("url")))
    outside = F.filter("link_hosts", lambda h: h != F.col("host"))
    other = F.size(F.filter("hrefs", lambda h: h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~h.rlike("(?i)^https?://")))
    return rows.withColumns({"external_hosts": F.array_distinct(outside), "external_links": F.size(outside), "internal_links": F.size("hrefs") - F.size(outside) - other, "link_text": F.lower(F.array_join("hrefs", " "))})


def images_of(tree: Column) -> tuple[Column, Column]:
    images = H.tags(tree, "img")
    return F.size(images), F.size(F.filter(images, lambda t: F.length(F.trim(H.attribute(t, "alt"))) > 5))


def dates_and_author(pages: DataFrame, as_of: Column) -> DataFrame:
    """``date_text``, ``fresh`` (180 days) and ``author`` of a page: JSON-LD first, then meta, time and author elements."""
    top = F.filter("ld.items", lambda i: i["top"])
    stated = F.aggregate(top, F.lit(None).cast("string"), lambda d, i: F.coalesce(i["date_modified"], d, i["date_published"]))
    time = T.once(F.get(F.filter(H.tags(_tree(), "time"), lambda t: H.attribute(t, "datetime").isNotNull()), F.lit(0)), lambda t: F.nullif(H.attribute(t, "datetime"), F.lit("")))
    date = F.coalesce(stated, H.meta(_tree(), "property", "article:modified_time"), H.meta(_tree(), "property", "article:published_time"), time)
    shown = H.elements_with(_tree(), "", lambda t: (H.attribute(t, "rel") == "author") | H.has_class(t, "author") | H.has_class(t, "byline") | F.contains(H.attribute(t, "class"), F.lit("author-name")))
    tagged = F.nullif(T.once(_tree(), lambda t: T.once(F.get(shown, F.lit(0)), lambda e: T.text_of(t, e))), F.lit(""))
    named = F.aggregate(top, F.lit(None).cast("string"), lambda a, i: F.coalesce(i["author_name"], a))
    rows = pages.withColumn("date_text", date).withColumn("author", F.coalesce(tagged, named))
    at = F.try_to_timestamp("date_text")
    return rows.withColumn("fresh", is_recent(at, as_of.cast("timestamp"), 180))


def richness(pages: DataFrame) -> DataFrame:
    """P10; needs ``links_of`` and ``dates_and_author``."""
    n_images, n_alt = images_of(_tree())
    trust = F.size(F.filter("hrefs", lambda h: _holds(h, ("privacy", "terms", "contact"))))
    video = F.col("seen").rlike(r"""(?i)<video[\s>]|<iframe[^>]*src=["'][^"']*(youtube|vimeo|wistia)""")
    rows = pages.withColumns({"statistics": _count(F.col("text"), STATISTICS), "n_images": n_images, "n_alt": n_alt, "n_trust_links": trust, "has_video": video})
    s, c, i = F.col("statistics"), F.size("external_hosts"), F.col("n_images")
    score = _score(
        *_steps(s, (1, 10), (3, 5), (5, 5)), *_steps(c, (1, 10), (3, 5), (5, 5)), *_steps(i, (1, 5), (2, 5)), ((F.col("n_alt") > 0) & (F.col("n_alt") >= i * 0.8), 5), (F.col("has_video"), 5),
        (F.col("date_text").isNotNull(), 5), (F.col("fresh"), 10), (F.col("author").isNotNull(), 15), (F.col("n_trust_links") >= 2, 10),
    )
    return rows.withColumn("richness_score", score)


def author_trust(pages: DataFrame) -> DataFrame:
    """P12; needs ``links_of`` and ``dates_and_author``. A Person of ``@graph`` is an author too; names in JSON-LD go before those shown."""
    person = lambda i: ~i["top"] & (i["type"] == "Person") & i["name"].isNotNull()
    named = F.aggregate("ld.items", F.lit(None).cast("string"), lambda a, i: F.coalesce(F.when(i["top"], i["author_name"]).when(person(i), i["name"]), a))
    of_class = lambda t, part: F.contains(H.attribute(t, "class"), F.lit(part))
    sections = H.elements_with(_tree(), "author", lambda t: of_class(t, "author"))
    bios = H.elements_with(_tree(), "author", lambda t: H.has_class(t, "author-bio") | H.has_class(t, "about-author") | of_class(t, "author-description") | of_class(t, "author-info"))
    bylines = F.concat(sections, H.elements_with(_tree(), "byline", lambda t: H.has_class(t, "byline")))
    marked = H.elements_with(_tree(), "author", lambda t: (H.attribute(t, "rel") == "author") | H.has_class(t, "author-name") | (H.attribute(t, "itemprop") == "author"))
    links = T.once(_tree(), lambda t: T.once(bylines, lambda bs: F.filter(T.of_name(t, "a"), lambda e: F.exists(bs, lambda b: (b["at"] < e["at"]) & (e["at"] < b["end"])))))
    shown = T.once(_tree(), lambda t: T.once(F.get(F.sort_array(F.concat(marked, links)), F.lit(0)), lambda e: F.nullif(T.text_of(t, e), F.lit(""))))
    joined = lambda found: T.once(_tree(), lambda t: F.array_join(F.transform(found, lambda e: T.raw_text(t, e)), ""))
    section = joined(sections)
    pages = pages.withColumn("author", F.coalesce(named, shown))
    bio = F.exists("ld.items", lambda i: F.when(i["top"], i["author_bio"]).otherwise(person(i) & i["own_bio"])) | (F.length(T.squeezed(joined(bios))) > 50)
    titles = F.exists("ld.items", lambda i: F.when(i["top"], i["author_credits"]).otherwise(person(i) & i["own_credits"]))
    credentials = titles | (F.col("author").isNotNull() & _any(section, CREDENTIALS))
    pages = pages.withColumns({"has_bio": bio, "has_credentials": credentials})
    trust = sum((F.when(_holds(F.col("link_text"), names), 1).otherwise(0) for names in (("privacy",), ("terms", "tos"), ("contact",), ("about",))), F.lit(0))
    sources = F.size(F.filter("external_hosts", lambda h: _holds(h, AUTHORITY_DOMAINS)))
    rows = pages.withColumns({"trust_pages": trust, "authority_links": sources})
    score = _score((F.col("author").isNotNull(), 20), (F.col("has_bio"), 15), (F.col("has_credentials"), 10), (F.col("date_text").isNotNull(), 5), (F.col("fresh"), 10), *((F.col("trust_pages") >= k, 5) for k in (1, 2, 3, 4)), *_steps(F.col("authority_links"), (1, 8), (3, 7), (5, 5)))
    return rows.withColumn("author_score", score)


def sections_of(pages: DataFrame) -> DataFrame:
    """``sections``: texts of the runs of a container's own children between those that are headings of level 2 or 3."""
    child = lambda t, e: F.when(e["name"].isin("h2", "h3"), "\u0001").otherwise(F.replace(T.text_of(t, e), F.lit("\u0001"), F.lit(" ")))
    children = T.once(_tree(), lambda t: F.transform(F.filter(t["elements"], lambda e: e["parent"] == F.col("main.at")), lambda e: child(t, e)))
    sections = F.filter(F.transform(F.split(F.array_join(children, " "), "\u0001"), T.squeezed), lambda s: s != "")
    return pages.withColumn("sections", sections)


def quality(pages: DataFrame) -> DataFrame:
    """P13."""
    paras = H.paragraphs(_tree())
    rows = pages.withColumn("paras", F.transform(paras, lambda p: F.split(F.lower(p), " ")))
    rows = sections_of(rows)

    def front(s: Column) -> Column:
        first60 = F.array_join(F.slice(F.split(s, " "), 1, 60), " ")
        sentence = F.length(F.get(F.split(first60, "[.!?]"), F.lit(0)))
        return (F.length(first60) > 30) & ~F.startswith(first60, F.lit("In this")) & ~F.startswith(first60, F.lit("Here")) & (sentence > 20) & (sentence < 200)

    pronouns = F.array(*map(F.lit, PRONOUNS))
    long = F.filter("paras", lambda p: F.size(p) >= 15)
    heavy = F.filter(long, lambda p: F.size(F.filter(p, lambda w: F.array_contains(pronouns, w))) / F.size(p) > 0.08)
    total = F.size("words")
    fillers = F.regexp_count(F.lower("text"), F.lit(edged(r"\b(" + "|".join(FILLERS) + r")\b")))
    sentences = F.size(F.filter(F.split("text", "[.!?]+"), lambda s: F.length(F.trim(s)) > 10))
    n_images, n_alt = images_of(_tree())
    marked = F.concat(F.transform(H.headings(_tree(), "1234"), lambda h: h["text"]), H.texts_of(_tree(), "strong", "b"))
    rows = rows.withColumns({
        "front_loaded": F.size(F.filter("sections", front)), "concise": F.size(F.filter("paras", lambda p: F.size(p).between(30, 70))),
        "self_contained": F.when(F.size(long) > 0, js_round((1 - F.size(heavy) / F.size(long)) * 100)).otherwise(F.lit(50).cast("long")),
        "fluff": js_round(F.greatest(F.lit(0.0), 1 - F.when(total > 0, fillers / total).otherwise(0.0) * 20) * 100),
        "fact_density": F.when(total > 0, _count(F.col("text"), FACTS) / total * 100).otherwise(0.0), "quality_tldr": F.exists(marked, lambda t: _holds(F.lower(t), TLDR_QUALITY)),
        "modular": F.size(F.filter("sections", lambda s: F.size(F.split(s, " ")).between(50, 500))), "alt_coverage": F.when(n_images > 0, js_round(n_alt / n_images * 100)).otherwise(F.lit(100).cast("long")),
        "readability": js_round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - (F.when(sentences > 0, total / sentences).otherwise(20.0) - 15) * 3))),
    })
    c = F.col
    score = _score(
        *_steps(c("front_loaded"), (1, 5), (3, 5), (5, 5)), *_steps(c("concise"), (2, 5), (5, 5)), *_steps(c("self_contained"), (70, 5), (85, 5)), *_steps(c("fluff"), (70, 5), (85, 5), (95, 5)), *_steps(c("fact_density"), (0.5, 5), (1, 5), (2, 5)),
        (c("quality_tldr"), 10), *_steps(c("modular"), (3, 5), (5, 5)), *_steps(c("alt_coverage"), (80, 5), (95, 5)), (c("readability") >= 60, 5),
    )
    return rows.withColumn("quality_score", score).drop("paras", "sections")


def page_type(tree: Column, ld: Column, hint: Column | None = None) -> Column:
    """The hint, else the type of a top-level JSON-LD object, else rules on the path of the canonical url."""
    types = F.transform(F.filter(ld["items"], lambda i: i["top"]), lambda i: i["type"])
    canonical = F.coalesce(T.once(F.get(F.filter(H.tags(tree, "link"), lambda t: F.lower(H.attribute(t, "rel")) == "canonical"), F.lit(0)), lambda t: H.attribute(t, "href")), F.lit(""))
    of = lambda *names: F.arrays_overlap(types, F.array(*map(F.lit, names)))
    path = path_of(F.when(canonical == "", "https://example.com").otherwise(canonical))
    rules = F.when(of("Product"), "product").when(of("BlogPosting", "NewsArticle"), "blog-post").when(of("Article"), "article").when(of("FAQPage"), "faq").when(of("LocalBusiness"), "local-business").when(of("Event"), "event")
    for pattern, name in (("(blog|news|post|article)", "blog-post"), ("(product|shop|store)", "product"), ("(service|services)", "service"), ("(about)", "about"), ("(contact)", "contact")):
        rules = rules.when(canonical.rlike(f"(?i)/{pattern}/"), name)
    rules = rules.when(((canonical == "") | canonical.rlike("^[A-Za-z]+://")) & path.isin("", "/"), "homepage").otherwise("page")
    return rules if hint is None else F.coalesce(hint, rules)


def _until_top(k: Column) -> Column:
    """How many items follow item k before the next one of the top level."""
    later = F.filter(F.transform("ld.items", lambda i, j: F.when(i["top"] & (j > k), j)), lambda j: j.isNotNull())
    return F.coalesce(F.get(later, F.lit(0)), F.size("ld.items")) - k - 1


def faq(pages: DataFrame) -> DataFrame:
    """P5: question headings, blocks that look like questions and answers, and FAQPage JSON-LD (top level or @graph)."""
    blocks = F.regexp_count("seen", F.lit(r"""(?i)<(?:[a-z0-9]+\s(?:[^>]*\s)?(?:class=["'][^"']*(?:faq|accordion)|id=["'][^"']*faq)|details[\s>]|dt[\s>])"""))
    questions = F.filter(H.headings(_tree(), "234"), lambda h: h["text"].rlike(QUESTION) | F.endswith(h["text"], F.lit("?")))
    # an object is one of questions by its own type, or by that of an item of its @graph; its own main entities count
    of_faq = F.transform("ld.items", lambda i, k: i["top"] & (i["type"].eqNullSafe("FAQPage") | F.exists(F.slice("ld.items", k + 2, _until_top(k)), lambda g: g["type"] == "FAQPage")))
    faq = F.filter(F.zip_with("ld.items", of_faq, lambda i, f: F.struct(f.alias("faq"), i["n_main"].alias("n"))), lambda x: x["faq"])
    count = F.aggregate(faq, F.lit(0), lambda s, x: s + x["n"])
    rows = pages.withColumns({"faq_schema": F.size(faq) > 0, "faq_questions": count, "qa_blocks": blocks, "question_headings": F.size(questions)})
    s = F.col("faq_schema")
    score = _score((s, 25), (s & (F.col("faq_questions") >= 3), 10), (s & (F.col("faq_questions") >= 5), 5), *_steps(F.col("qa_blocks"), (1, 15), (3, 10), (5, 5)), *_steps(F.col("question_headings"), (1, 15), (3, 10), (5, 5)))
    return rows.withColumn("faq_score", score)


def feeds(pages: DataFrame, robots: str = "robots_txt") -> DataFrame:
    """P7."""
    link_types = F.transform(H.tags(_tree(), "link"), lambda t: F.struct(F.lower(H.attribute(t, "type")).alias("type"), F.lower(H.attribute(t, "rel")).alias("rel"), H.attribute(t, "href").alias("href")))
    rows = pages.withColumn("links_in_head", link_types)
    of = lambda kind: F.filter("links_in_head", lambda t: (t["type"] == kind) & (F.length(t["href"]) > 0))
    rss, atom = F.size(of("application/rss+xml")), F.size(of("application/atom+xml"))
    hrefs = F.transform(H.tags(_tree(), "a"), lambda t: H.attribute(t, "href"))
    sitemap = F.exists(hrefs, lambda h: h.rlike(r"(?i)sitemap.*\.xml") & F.contains(h, F.lit("sitemap"))) | F.coalesce(F.col(robots).rlike(r"(?im)^sitemap:\s*\S"), F.lit(False))
    llms = F.exists("links_in_head", lambda t: t["href"].rlike(r"llms\.txt|llms-full")) | F.exists(hrefs, lambda h: F.contains(h, F.lit("llms.txt")))
    rows = rows.withColumns({"n_rss": rss, "n_atom": atom, "has_sitemap": F.coalesce(sitemap, F.lit(False)), "has_manifest": F.exists("links_in_head", lambda t: t["rel"] == "manifest"), "has_llms_txt": F.coalesce(llms, F.lit(False))})
    r, a = F.col("n_rss") > 0, F.col("n_atom") > 0
    score = _score((r | a, 25), (F.col("has_sitemap"), 30), (F.coalesce("has_manifest", F.lit(False)), 10), (F.col("has_llms_txt"), 25), (r & a, 5), (F.col("n_rss") + F.col("n_atom") >= 2, 5))
    return rows.withColumn("feed_score", score).drop("links_in_head")


def sensitivity(pages: DataFrame) -> DataFrame:
    """P20, S3: the category of most keywords per word, and the trust signals it asks for; needs ``links_of``."""
    # an empty text counts as one word
    n = F.greatest(F.size(F.split("body_text", " ")), F.lit(1))
    density = [F.regexp_count("body_text", F.lit(edged(rf"(?i)\b({words})\b"))) / n for _, words, _ in SENSITIVE]
    ranked = F.array(*(F.struct(d.alias("density"), F.lit(-k).alias("ord"), F.lit(name).alias("category"), F.array(*map(F.lit, signals)).alias("required")) for k, (d, (name, _, signals)) in enumerate(zip(density, SENSITIVE, strict=True))))
    rows = pages.withColumn("top", F.array_max(F.filter(ranked, lambda x: x["density"] > 0.005)))
    lower = F.lower("body_text")
    ld = F.array_join(H.json_ld(_tree()), " ")
    named = H.elements_with(_tree(), "", lambda t: (H.attribute(t, "rel") == "author") | H.has_class(t, "author-name") | H.has_class(t, "byline") | (H.attribute(t, "itemprop") == "author"))
    section = T.once(_tree(), lambda t: F.array_join(F.transform(H.elements_with(t, "author", lambda x: F.contains(H.attribute(x, "class"), F.lit("author"))), lambda e: T.raw_text(t, e)), ""))
    dated = F.exists(H.tags(_tree(), "time"), lambda t: H.attribute(t, "datetime").isNotNull()) | F.exists(H.tags(_tree(), "meta"), lambda t: F.coalesce(H.attribute(t, "property") == "article:modified_time", F.lit(False)))
    signals = {
        "namedAuthor": (F.size(named) > 0) | F.contains(ld, F.lit('"author"')),
        "authorCredentials": section.rlike(edged(SENSITIVE_CREDENTIALS)),
        **{name: _holds(lower, texts) for name, texts in DISCLAIMERS.items()},
        "dateModified": dated | F.contains(ld, F.lit('"dateModified"')),
        "primarySources": F.col("external_links") >= 3,
    }
    present = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in signals.items())), lambda x: x.isNotNull())
    is_ymyl = F.coalesce(F.col("top.density") > 0.01, F.lit(False))
    rows = rows.withColumns({"is_ymyl": is_ymyl, "present": F.when(is_ymyl, F.array_intersect("top.required", present))})
    confidence = F.when(~F.col("is_ymyl"), "low").when(F.col("top.density") > 0.03, "high").when(F.col("top.density") > 0.015, "medium").otherwise("low")
    score = F.when(F.col("is_ymyl"), js_round(F.size("present") / F.size("top.required") * 100)).otherwise(F.lit(100).cast("long"))
    return rows.withColumns({"ymyl_category": F.when(F.col("is_ymyl"), F.col("top.category")), "ymyl_confidence": confidence, "missing": F.when(F.col("is_ymyl"), F.array_except("top.required", "present")), "trust_score": score}).drop("top")


def information_gain(pages: DataFrame) -> DataFrame:
    """Signals of novelty; none to five give the score."""
    visuals = F.col("html").rlike(r"""(?i)<canvas[\s>]|<svg[^>]*class=["'][^"']*chart|class=["'][^"']*(chart|graph)|data-chart""")

    def signal(name: str) -> Column:
        # a pattern is tried only where the text has what a match must hold
        out = F.lit(False)
        for pattern, needs in zip(NOVELTY[name], NOVELTY_NEEDS[name], strict=True):
            out = out | (_holds(F.col("lowered"), needs) & F.col("text").rlike(edged(pattern)))
        return F.when(out, F.lit(name))

    found = [*map(signal, NOVELTY), F.when(visuals, F.lit("Custom data visualizations"))]
    rows = pages.withColumn("lowered", F.lower("text")).withColumn("novelty", F.filter(F.array(*found), lambda x: x.isNotNull())).drop("lowered")
    return rows.withColumn("gain_score", F.get(F.array(*(F.lit(x).cast("long") for x in (15, 35, 55, 70, 85, 100))), F.size("novelty")))


def topical_depth(pages: DataFrame) -> DataFrame:
    """P23; needs ``links_of``. Repeated pairs of words are counted inside the row: sorted, a pair equal to the next."""
    tops = F.transform(F.filter(H.headings(_tree(), "234"), lambda h: F.length(h["text"]) > 3), lambda h: F.lower(h["text"]))
    rows = pages.withColumn("subtopics", tops).withColumn("lowered", F.transform("words", lambda w: F.lower(w)))
    n = F.size("words")
    pairs = F.zip_with(F.slice("lowered", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("lowered", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    rows = rows.withColumn("pairs", F.array_sort(F.filter(pairs, lambda p: F.length(p) > 6)))
    again = F.transform("pairs", lambda p, i: F.when((i > 0) & (F.get("pairs", i - 1) == p), p))
    vocabulary = F.array_distinct(F.filter(F.flatten(F.transform("subtopics", lambda t: F.split(t, " "))), lambda w: F.length(w) > 3))
    repeated = F.size(F.array_distinct(F.filter(again, lambda p: p.isNotNull())))
    rows = rows.withColumns({"n_subtopics": F.size("subtopics"), "heading_words": F.size(vocabulary), "repeated_pairs": repeated})
    density = F.when(n > 0, F.col("repeated_pairs") / n * 100).otherwise(0.0)
    depth = F.when(F.col("n_subtopics") > 0, n / F.col("n_subtopics")).otherwise(n.cast("double"))
    score = _score(
        *_steps(F.col("n_subtopics"), (3, 15), (5, 10), (8, 5)), *_steps(F.col("heading_words"), (10, 10), (20, 5)), *_steps(F.col("internal_links"), (3, 10), (10, 10)), *_steps(density, (0.5, 10), (1, 5)),
        (depth.between(100, 500), 15), ((depth >= 50) & ~depth.between(100, 500), 5), (n >= 500, 5),
    )
    return rows.withColumns({"pair_density": js_round(density * 100) / 100, "depth_ratio": js_round(depth), "depth_score": score}).drop("pairs", "lowered", "subtopics")


def conversational(pages: DataFrame) -> DataFrame:
    """P24."""
    heads = H.headings(_tree(), "1234")
    paras = F.filter(H.paragraphs(_tree()), lambda p: F.length(p) >= 30)
    rows = pages.withColumns({"heads": F.transform(heads, lambda h: h["text"]), "paras": paras})
    asked = F.size(F.filter("heads", lambda h: h.rlike(r"(?i)^(what|how|why|when|where|who|which|can|does|is|are|should|could|will)\s") | F.endswith(h, F.lit("?"))))
    you = edged(r"(?i)\byou(r|'re|'ll|'ve)?\b")
    speaks = F.size(F.filter("paras", lambda p: _any(p, STARTERS))) + F.size(F.filter("paras", lambda p: p.rlike(you)))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = rows.withColumns({"question_ratio": ratio(asked, F.size("heads")), "language_ratio": F.least(F.lit(1.0), ratio(speaks, F.size("paras"))), "direct_answers": F.size(F.filter("paras", lambda p: _any(p, DIRECT))), "query_phrases": _count(F.lower("body_text"), QUERY_PHRASES)})
    tone = (F.col("language_ratio") > 0.2) | (F.col("question_ratio") > 0.3) | F.col("body_text").rlike(edged(r"(?i)\b(you|your|you're)\b"))
    score = _score(*_steps(F.col("question_ratio"), (0.1, 5), (0.25, 10), (0.5, 5)), *_steps(F.col("language_ratio"), (0.1, 5), (0.2, 10), (0.4, 5)), *_steps(F.col("direct_answers"), (1, 5), (3, 10), (5, 5)), *_steps(F.col("query_phrases"), (2, 5), (5, 10), (10, 5)), (tone, 20))
    return rows.withColumn("conversation_score", score).drop("heads", "paras")


def indexnow_score(key_text: Column, robots: Column) -> Column:
    """P25: a key file of 8 to 128 signs, else a mention in robots.txt."""
    key = F.length(F.trim(key_text)).between(8, 128)
    return F.when(key, 80).when(robots.rlike("(?i)indexnow"), 20).otherwise(0)


def content_hash(*facts: Column) -> Column:
    """MD5 of the extraction record with its fields in a fixed order, without the time to the first byte."""
    return F.md5(F.to_json(F.struct(*facts), {"ignoreNullFields": "false"}))
