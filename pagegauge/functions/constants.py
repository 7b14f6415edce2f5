"""Weights, bounds, patterns and texts that results depend on."""

from __future__ import annotations

#: Sub-score and its weight in the page score, in the order in which they are added.
SUB_SCORE_WEIGHTS = {
    "schema": 0.12, "entity": 0.08, "speakable": 0.05, "structure": 0.10, "faq": 0.08, "summary": 0.08, "feed": 0.05, "crawlAccess": 0.08,
    "contentRichness": 0.06, "botBlocking": 0.08, "schemaAccuracy": 0.06, "authorEeat": 0.10, "contentQuality": 0.06,
}
SUB_SCORES = tuple(SUB_SCORE_WEIGHTS)

LAYER_WEIGHTS = {
    "access": {"crawlAccess": 0.35, "feed": 0.25, "botBlocking": 0.40},
    "understanding": {"schema": 0.25, "structure": 0.20, "entity": 0.20, "schemaAccuracy": 0.15, "authorEeat": 0.20},
    "extractability": {"faq": 0.20, "summary": 0.20, "contentRichness": 0.20, "contentQuality": 0.20, "speakable": 0.20},
}

#: Tiers and their lower bounds, best first.
TIERS = (("authority", 90), ("extractable", 70), ("readable", 40), ("invisible", 0))
TIER_ORDER = ("invisible", "readable", "extractable", "authority")

#: Monthly credits, domains (None: no limit) and price of each plan.
PLAN_CREDITS = {"free": 5, "pro": 5_000, "agency": 25_000, "enterprise": 100_000}
PLAN_DOMAINS = {"free": 0, "pro": 10, "agency": 50, "enterprise": None}
PLAN_PRICES = {"free": 0, "pro": 49, "agency": 199, "enterprise": 499}

#: Crawlers by user agent; the first that matches names the visit.
BOTS = (
    ("GPTBot", "(?i)GPTBot"),
    ("ClaudeBot", "(?i)ClaudeBot|anthropic"),
    ("PerplexityBot", "(?i)PerplexityBot"),
    ("Google-Extended", "(?i)Google-Extended"),
    ("Googlebot", "(?i)Googlebot(?!-)"),
    ("Bingbot", "(?i)bingbot"),
    ("ChatGPT-User", "(?i)ChatGPT-User"),
    ("Bytespider", "(?i)Bytespider"),
    ("CCBot", "(?i)CCBot"),
    ("Applebot", "(?i)Applebot"),
    ("Meta-ExternalAgent", "(?i)Meta-ExternalAgent"),
)

#: Sub-score, threshold below which a page has the issue, and its text.
ISSUES = (
    ("faq", 20, "Missing FAQ/Q&A content"),
    ("schema", 30, "Missing or minimal structured data"),
    ("summary", 30, "No meta description or front-loaded summary"),
    ("feed", 20, "Missing sitemap/feed references"),
    ("entity", 30, "Low entity density"),
    ("structure", 40, "Poor heading hierarchy or content structure"),
    ("crawlAccess", 50, "Crawl access issues (missing canonical, noindex, etc.)"),
)

#: Fix rules in their order: sub-score, gate (below it; speakable: at 0), condition on facts, points, layer, factor, text.
FIXES = (
    ("crawlAccess", 60, "not is_https", 8, "access", "1.8", "Migrate to HTTPS. AI crawlers and search engines prefer secure connections."),
    ("crawlAccess", 60, "not has_canonical", 5, "access", "1.12", "Add a canonical URL tag to prevent duplicate content issues with AI crawlers."),
    ("crawlAccess", 60, "is_spa", 12, "access", "1.4", "Implement server-side rendering (SSR). AI crawlers often cannot execute JavaScript to access your content."),
    ("schema", 50, "json_ld_count = 0", 15, "understanding", "2.1", "Add JSON-LD structured data. This is the preferred format for AI systems to understand your content."),
    ("schema", 50, "not has_primary_type", 10, "understanding", "2.1", "Add a primary schema type (Article, Product, or LocalBusiness) that matches your page content."),
    ("schema", 50, "not has_breadcrumb", 5, "understanding", "2.11", "Add BreadcrumbList schema to help AI systems understand your site hierarchy."),
    ("structure", 60, "not hierarchy_valid", 8, "understanding", "3.4", "Fix heading hierarchy. Use a single H1 and maintain proper H2 > H3 > H4 nesting without skipping levels."),
    ("structure", 60, "list_count = 0", 5, "extractability", "3.10", "Add bulleted or numbered lists to break up content. AI systems extract list items as discrete facts."),
    ("structure", 60, "word_count < 300", 8, "extractability", "3.9", "Add more substantive content. Pages under 300 words provide insufficient signal for AI systems to extract."),
    ("faq", 40, "not has_faq_schema", 12, "extractability", "2.5", "Add FAQPage structured data with at least 3 question-answer pairs relevant to your topic."),
    ("faq", 40, "question_headings = 0", 8, "extractability", "3.6", "Include question-format headings (Who, What, When, Where, Why, How) that mirror how users ask AI systems."),
    ("summary", 50, "meta_description_length = 0", 8, "extractability", "3.5", "Add a meta description (120-160 characters) that concisely defines what this page covers."),
    ("summary", 50, "not has_definition", 10, "extractability", "3.1", "Start your content with a clear definition or direct answer in the first paragraph."),
    ("summary", 50, "not has_tldr", 5, "extractability", "3.14", 'Add a "Key Takeaways" or summary section at the top of long-form content.'),
    ("feed", 40, "not has_sitemap", 10, "access", "1.10", "Create and submit an XML sitemap. This is essential for AI crawlers to discover all your content."),
    ("feed", 40, "not has_rss", 5, "access", "1.10", "Add an RSS feed. Some AI systems use feeds to discover and track content updates."),
    ("feed", 40, "not has_llms_txt", 8, "access", "1.16", "Add an llms.txt file to provide AI systems with a structured overview of your site content."),
    ("entity", 40, "entity_density < 1", 8, "understanding", "4.1", "Increase named entity density. Use specific names, brands, locations, and technical terms rather than generic language."),
    ("contentRichness", 50, "not has_author", 10, "extractability", "5.1", "Add a named author with credentials. AI systems use author signals for E-E-A-T assessment."),
    ("contentRichness", 50, "not has_fresh_date", 8, "extractability", "5.12", "Add or update the dateModified in Article schema. AI systems strongly prefer recent content."),
    ("contentRichness", 50, "not has_citations", 7, "extractability", "5.9", "Add outbound links to authoritative sources. Primary-source citations increase trust signals."),
    ("contentRichness", 50, "not has_statistics", 6, "extractability", "3.9", "Include verifiable statistics and data points. Fact-dense content is more likely to be cited by AI."),
    ("speakable", 1, "true", 5, "extractability", "2.10", "Add speakable structured data to indicate which content sections are suitable for voice assistant readout."),
)

#: Citation simulation: platform and the weights of its score, in the order in which they are added.
CITATION_WEIGHTS = {
    "Google AI Overviews": {"schema": 0.30, "structure": 0.20, "entity": 0.15, "contentRichness": 0.20, "crawlAccess": 0.15},
    "ChatGPT": {"structure": 0.25, "summary": 0.20, "entity": 0.20, "contentRichness": 0.20, "faq": 0.15},
    "Perplexity": {"contentRichness": 0.30, "summary": 0.20, "structure": 0.20, "entity": 0.15, "feed": 0.15},
    "Gemini": {"schema": 0.30, "entity": 0.20, "structure": 0.20, "crawlAccess": 0.15, "contentRichness": 0.15},
    "Voice Assistants": {"speakable": 0.30, "summary": 0.25, "faq": 0.20, "structure": 0.15, "schema": 0.10},
    "Microsoft Copilot": {"structure": 0.25, "schema": 0.20, "entity": 0.20, "contentRichness": 0.20, "crawlAccess": 0.15},
}
#: Reasoning for scores from 70, from 40 and below (one text for both where a platform has only two).
CITATION_REASONS = {
    "Google AI Overviews": ("Strong schema and content structure align well with Google AI Overview selection criteria.", "Some structural elements present but gaps in schema or content depth limit citation likelihood.", "Significant gaps in structured data and content signals reduce visibility in AI Overviews."),
    "ChatGPT": ("Well-structured, authoritative content is likely to be referenced in ChatGPT responses.", "Content has some extractable elements but lacks the depth or authority for consistent citation.", "Content structure and authority signals are insufficient for reliable ChatGPT citation."),
    "Perplexity": ("Strong citation density and fresh content align with Perplexity's research-oriented approach.", "Some relevant signals present but recency or citation depth could be improved.", "Lacks the recency and citation signals that Perplexity prioritizes."),
    "Gemini": ("Strong Google ecosystem alignment through structured data and entity signals.", "Improving schema markup and entity clarity would increase Gemini visibility.", "Improving schema markup and entity clarity would increase Gemini visibility."),
    "Voice Assistants": ("Speakable markup and concise answer blocks make this content voice-assistant ready.", "Adding speakable schema and front-loaded direct answers would improve voice readiness.", "Adding speakable schema and front-loaded direct answers would improve voice readiness."),
    "Microsoft Copilot": ("Well-structured content with strong entity signals aligns with Copilot's approach.", "Strengthening content structure and entity clarity would improve Copilot citation likelihood.", "Strengthening content structure and entity clarity would improve Copilot citation likelihood."),
}
STRENGTHS = (
    ("schema >= 70", "Strong structured data implementation"), ("structure >= 70", "Well-organized content hierarchy"), ("faq >= 60", "FAQ content enhances extractability"),
    ("contentRichness >= 60", "Rich content with supporting evidence"), ("crawlAccess >= 70", "Excellent crawl accessibility"), ("speakable > 0", "Voice-assistant ready with speakable markup"),
    ("has_author", "Named author establishes authority"), ("has_fresh_date", "Recent content date signals relevance"),
)
WEAKNESSES = (
    ("schema < 30", "Missing or minimal structured data"), ("structure < 40", "Poor content organization and heading hierarchy"), ("faq < 20", "No FAQ or Q&A content for direct extraction"),
    ("summary < 30", "Lacks concise definitions and summaries"), ("entity < 30", "Low entity density reduces topical authority"), ("feed < 20", "Missing sitemap and feed discovery mechanisms"),
    ("speakable = 0", "No speakable markup for voice assistants"), ("crawlAccess < 40", "Crawl accessibility issues may block AI systems"),
)

#: Platform readiness: platform, its name, and its signals (name, column, least value, weight, description) in order.
PLATFORMS = (
    ("google-aio", "Google AI Overviews", (
        ("Schema Markup", "schema", 60, 0.25, "Rich structured data (+73% citation boost in AI Overviews)"), ("Entity Density", "entity", 50, 0.15, "Clear entity identification for Knowledge Graph alignment"),
        ("Content Structure", "structure", 60, 0.15, "Heading hierarchy and organized content"), ("FAQ Content", "faq", 40, 0.15, "Question-answer patterns match AI Overview extraction"),
        ("E-E-A-T Signals", "authorEeat", 50, 0.15, "Author authority and trust signals"), ("Schema Accuracy", "schemaAccuracy", 70, 0.10, "Accurate structured data matches page content"),
        ("Domain Authority", "authority", 40, 0.05, "Off-site authority signals (76% top-10 overlap)"))),
    ("chatgpt", "ChatGPT", (
        ("Content Quality", "contentQuality", 50, 0.25, "Encyclopedic, well-structured content favored by ChatGPT"), ("Content Structure", "structure", 50, 0.20, "Clean heading hierarchy for content extraction"),
        ("Bot Access", "botBlocking", 80, 0.20, "GPTBot not blocked in robots.txt or by WAF"), ("Entity Coverage", "entity", 40, 0.10, "Clear entity definitions for training data quality"),
        ("Content Richness", "contentRichness", 50, 0.10, "Citations, statistics, and factual depth"), ("Summary Density", "summary", 50, 0.10, "Clear meta descriptions and front-loaded summaries"),
        ("Domain Authority", "authority", 30, 0.05, "Established domain credibility"))),
    ("perplexity", "Perplexity", (
        ("Content Freshness", "is_fresh", 1, 0.25, "dateModified within 90 days (strongest recency weight among platforms)"), ("Citation Density", "contentRichness", 50, 0.20, "Research-style citations and source references"),
        ("Bot Access", "botBlocking", 80, 0.20, "PerplexityBot not blocked"), ("Content Quality", "contentQuality", 50, 0.15, "Fact-dense, low-fluff content"),
        ("Feed Presence", "feed", 40, 0.10, "RSS/Atom feeds for content discovery"), ("Author Authority", "authorEeat", 50, 0.10, "Named author with credentials"))),
    ("gemini", "Gemini", (
        ("Schema Completeness", "schema", 60, 0.25, "Rich structured data aligned with Google ecosystem"), ("E-E-A-T Signals", "authorEeat", 50, 0.25, "Strong author credentials and trust pages"),
        ("Entity Density", "entity", 50, 0.15, "Clear entities for Knowledge Graph alignment"), ("Content Structure", "structure", 50, 0.15, "Well-organized content hierarchy"),
        ("Schema Accuracy", "schemaAccuracy", 70, 0.10, "Structured data matches visible content"), ("Domain Authority", "authority", 40, 0.10, "Knowledge Graph presence and authority signals"))),
    ("voice", "Voice Assistants", (
        ("Speakable Markup", "speakable", 50, 0.30, "Speakable schema markup for voice-optimized content"), ("Direct Answers", "contentQuality", 50, 0.25, "Front-loaded, concise answers (40-60 word blocks)"),
        ("FAQ Structure", "faq", 50, 0.20, "Question-answer pairs for voice assistant extraction"), ("Summary Density", "summary", 50, 0.15, "Clear definitions and TL;DR summaries"),
        ("Schema Markup", "schema", 50, 0.10, "Structured data for featured snippet eligibility"))),
    ("copilot", "Microsoft Copilot", (
        ("Bot Access", "botBlocking", 80, 0.20, "Bingbot not blocked (Copilot uses Bing index)"), ("Content Structure", "structure", 50, 0.20, "Clean hierarchy for Bing content extraction"),
        ("Schema Markup", "schema", 50, 0.20, "Structured data for enhanced Bing indexing"), ("E-E-A-T Signals", "authorEeat", 40, 0.15, "Enterprise verification and authority signals"),
        ("Content Quality", "contentQuality", 40, 0.15, "Well-written, factual content"), ("Domain Authority", "authority", 30, 0.10, "LinkedIn/GitHub ecosystem bias for Microsoft Copilot"))),
)

#: Probe agents and the penalty when one is blocked.
PROBE_PENALTIES = {"browser": 50, "GPTBot": 20, "ClaudeBot": 20, "PerplexityBot": 15, "Googlebot": 25, "Bingbot": 15}
WAF_PENALTY = 5
#: Authority signals and their weights.
AUTHORITY_WEIGHTS = {"kg": 0.25, "wikidata": 0.20, "backlinks": 0.55}
