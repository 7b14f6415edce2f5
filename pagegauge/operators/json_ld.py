"""JSON-LD of pages: items, types, accuracy and contradictions; every rule on what the walk of the blocks finds is a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import json_ld as J
from ..functions import tree as T
from ..functions.exprs import fuzzy_match

# Types that count, and the names of the flags.
VALUABLE = ("faqpage", "howto", "product", "review", "aggregaterating", "localbusiness", "article", "newsarticle", "blogposting", "organization", "person", "breadcrumblist", "event", "website", "webpage", "itemlist", "recipe", "course", "videoobject", "softwareapplication")
FLAGS = {
    "faqPage": ("faqpage",), "howTo": ("howto",), "product": ("product",), "review": ("review", "aggregaterating"), "localBusiness": ("localbusiness",), "article": ("article", "newsarticle", "blogposting"),
    "organization": ("organization",), "person": ("person",), "breadcrumb": ("breadcrumblist",), "event": ("event",), "webSite": ("website", "webpage"),
}


def with_json_ld(pages: DataFrame) -> DataFrame:
    """``ld``, the parsed items of a page's blocks; a block that is no JSON is skipped and counted."""
    if "tree" not in pages.columns:
        pages = pages.withColumn("tree", T.parsed_column("html"))
    return pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("ld", J.facts_column("tree"))


def schema_score(pages: DataFrame) -> DataFrame:
    """Types of JSON-LD, microdata and RDFa, their flags and the score; needs ``ld``."""
    micro = F.transform(F.regexp_extract_all("html", F.lit(r"""(?i)\sitemtype=["'][^"']*schema\.org/(\w+)"""), F.lit(1)), lambda t: t)
    rdfa = F.flatten(F.transform(F.regexp_extract_all("html", F.lit(r"""(?i)\stypeof=["']([^"']*)["']"""), F.lit(1)), lambda t: F.transform(F.split(t, r"\s+"), lambda x: F.regexp_replace(x, "^schema:", ""))))
    has_micro = F.col("html").rlike(r"(?i)<[^>]*\sitemscope")
    types = F.array_distinct(F.filter(F.concat("ld.types", F.when(has_micro, micro).otherwise(F.array().cast("array<string>")), rdfa), lambda t: t != ""))
    rows = pages.withColumns({"schema_types": types, "has_microdata": has_micro})
    lower = F.transform("schema_types", lambda t: F.lower(t))

    def flag(names: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | F.exists(lower, lambda t: F.contains(t, F.lit(n)))  # noqa: B023
        return out

    rows = rows.withColumns({f"is_{k}": flag(v) for k, v in FLAGS.items()}).withColumn("is_speakable", F.col("ld.speakable") | F.col("html").rlike(r"""(?i)<meta[^>]*name=["']speakable"""))
    valuable = F.size(F.filter(lower, lambda t: F.array_contains(F.array(*map(F.lit, VALUABLE)), t)))
    n = F.size("schema_types")
    add = lambda c, p: F.when(c, p).otherwise(0)
    objects = F.col("ld.n_objects") > 0
    score = add(n > 0, 20) + add(n >= 3, 15) + F.least(valuable * 10, F.lit(40)) + add(F.col("is_speakable"), 10) + add(objects, 5) + add(objects & F.col("has_microdata"), 5) + add(F.col("is_breadcrumb"), 5)
    return rows.withColumn("schema_score", F.least(F.lit(100), score).cast("long"))


def _visible_claims(pages: DataFrame) -> DataFrame:
    tree = F.col("tree")
    first = lambda name: F.coalesce(F.get(H.texts_of(tree, name), F.lit(0)), F.lit(""))
    title, h1 = first("title"), first("h1")
    return pages.withColumns({"page_title": title, "page_h1": h1, "page_description": F.coalesce(H.meta(tree, "name", "description"), F.lit(""))})


def schema_accuracy(pages: DataFrame, as_of: Column) -> DataFrame:
    """Do the items agree with what the page shows? 100 minus penalties; needs ``ld`` and the page's parts."""
    rows = _visible_claims(pages)
    title, h1, desc, items = F.col("page_title"), F.col("page_h1"), F.col("page_description"), F.col("ld.items")
    later = F.timestamp_add("DAY", F.lit(1), as_of.cast("timestamp"))

    def bad_title(i: Column) -> Column:
        t = F.coalesce(i["headline"], i["name"])
        return F.coalesce((title != "") & ~fuzzy_match(t, title) & ~fuzzy_match(t, h1), F.lit(False))

    def bad_description(i: Column) -> Column:
        d = i["description"]
        return F.coalesce((F.length(d) > 10) & (F.length(desc) > 10) & ~fuzzy_match(F.substring(d, 1, 80), F.substring(desc, 1, 80)), F.lit(False))

    def bad_dates(i: Column) -> Column:
        total = F.lit(0)
        for c in ("date_published", "date_modified", "date_created"):
            at = F.try_to_timestamp(i[c])
            total = total + F.when(i[c].isNotNull() & (at.isNull() | (at > later)), 1).otherwise(0)
        return total

    def bad_author(i: Column) -> Column:
        return F.coalesce((F.length(i["author"]) > 2) & ~F.contains(F.col("body_text"), i["author"]), F.lit(False))

    def lacking(i: Column) -> Column:
        return F.when((i["type"] == "Product") & ~i["has_offers"], 1).when((i["type"] == "Article") & ~i["has_author"], 1).when(i["type"].isin("Review", "AggregateRating") & ~i["has_rating"], 1).otherwise(0)

    count = lambda f: F.aggregate(F.transform(items, f), F.lit(0), lambda s, x: s + x)
    as_int = lambda f: lambda i: F.when(f(i), 1).otherwise(0)
    rows = rows.withColumns({"bad_titles": count(as_int(bad_title)), "bad_descriptions": count(as_int(bad_description)), "bad_dates": count(bad_dates), "bad_authors": count(as_int(bad_author)), "missing_fields": count(lacking)})
    issues = sum((F.col(c) for c in ("bad_titles", "bad_descriptions", "bad_dates", "bad_authors", "missing_fields")), F.col("ld.n_bad"))
    rows = rows.withColumn("n_issues", issues)
    penalty = sum((F.when(F.col(c) > 0, p).otherwise(0) for c, p in (("bad_titles", 20), ("bad_descriptions", 15), ("bad_dates", 20), ("bad_authors", 15))), F.least(F.col("n_issues") * 5, F.lit(30)))
    return rows.withColumn("accuracy_score", F.greatest(F.lit(0), 100 - penalty).cast("long"))


def hallucination_risk(pages: DataFrame, as_of: Column) -> DataFrame:
    """Claims of top-level items against the whole text; needs ``ld`` and the page's parts."""
    rows = _visible_claims(pages).withColumn("excerpt", F.lower("text"))
    items = F.filter("ld.items", lambda i: i["top"])
    later = F.timestamp_add("DAY", F.lit(1), as_of.cast("timestamp"))
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    soft = F.transform(items, lambda i: flag((F.length(i["author"]) > 2) & ~F.contains(F.col("excerpt"), F.lower(i["author"]))) + flag((F.col("page_h1") != "") & ~fuzzy_match(i["headline"], F.col("page_h1"))))
    hard = F.transform(items, lambda i: flag(F.try_to_timestamp(i["date_published"]) > later) + flag(F.try_to_timestamp(i["date_modified"]) > later) + flag(i["rating"] > i["best"]))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    rows = rows.withColumns({"inconsistencies": total(soft), "contradictions": total(hard)})
    c, n = F.col("contradictions"), F.col("inconsistencies")
    level = F.when(c >= 2, "high").when((c >= 1) | (n >= 3), "medium").otherwise("low")
    return rows.withColumns({"risk_score": F.greatest(F.lit(0), 100 - c * 20 - n * 10).cast("long"), "risk_level": level}).drop("excerpt")
