"""Admission, normalisation and discovery of urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Links to these are never pages.
ASSETS = r"\.(jpg|jpeg|png|gif|svg|webp|css|js|pdf|zip|mp3|mp4|woff|woff2|ico)$"
ADMIN_PATHS = r"/(wp-admin|wp-json|feed)"
_PRIVATE = r"^(localhost|127\.0\.0\.1|\[?::1\]?|0\.0\.0\.0)$|^10\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[01])\.|\.(local|internal)$"


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute url, without user and port; empty if it has none."""
    return F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def url_reject_reason(url: Column) -> Column:
    """why a url is not admitted; null if it is. Only http and https, no private or local hosts."""
    scheme, host = scheme_of(url), host_of(url)
    return F.when(url.isNull() | (host == ""), "invalid").when(~scheme.isin("http", "https"), "scheme").when(host.rlike(_PRIVATE), "private_host")


def normal_url(url: Column) -> Column:
    """the url without fragment and without the slash that ends a longer path; null if not http.

    Scheme and host are lower case, the scheme's own port goes, and an empty path is "/".
    """
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme, host, path, query = scheme_of(whole), host_of(whole), path_of(whole), query_of(whole)
    port = F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*)(:[0-9]+)", 1)
    port = F.when(((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443")), "").otherwise(port)
    path = F.when(path == "", "/").when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    out = F.concat(scheme, F.lit("://"), host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (host != ""), out)


def page_links(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """distinct urls of the same host that a page refers to; assets and administration paths left out."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""href=["']([^"']+)["']"""), F.lit(1))
    base = F.regexp_extract(url, r"^(\s*[A-Za-z]+://[^/?#]*)", 1)
    # the references of a page are made distinct before they become rows
    rows = pages.select(page, F.col(url).alias("page_url"), base.alias("base"), F.explode(F.array_distinct(hrefs)).alias("href"))
    href, bare = F.col("href"), F.regexp_replace("page_url", "[?#].*$", "")
    folder = F.regexp_replace(F.regexp_replace(bare, r"^(\s*[A-Za-z]+://[^/]*)$", "$1/"), "[^/]*$", "")
    absolute = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme_of(F.col("page_url")), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat("base", "href"))
        .when(F.startswith(href, F.lit("#")) | F.startswith(href, F.lit("?")), F.concat(bare, href))
        .otherwise(F.concat(folder, href))
    )
    out = rows.select(page, "page_url", absolute.alias("link"))
    path = F.lower(path_of(F.col("link")))
    out = out.where((host_of(F.col("link")) == host_of(F.col("page_url"))) & scheme_of(F.col("link")).isin("http", "https") & ~path.rlike(ASSETS) & ~path.rlike(ADMIN_PATHS))
    return out.select(page, normal_url(F.col("link")).alias("link")).where("link is not null").distinct()


def discovered(homepages: DataFrame, from_sitemaps: DataFrame, from_links: DataFrame, max_pages: int = 100) -> DataFrame:
    """Pages of a site from its homepage, sitemaps and links; the first source of a url wins; by priority, cut.

    Inputs are (site, url, ord), sitemaps also (priority).
    """
    source = lambda df, rank, name, priority: df.select("site", normal_url(F.col("url")).alias("url"), F.lit(rank).alias("rank"), F.lit(name).alias("source"), priority.cast("double").alias("priority"), "ord")
    rows = source(homepages, 0, "homepage", F.lit(1.0)).unionByName(source(from_sitemaps, 1, "sitemap", F.col("priority"))).unionByName(source(from_links, 2, "link", F.lit(0.3)))
    first = rows.where("url is not null").groupBy("site", "url").agg(F.min(F.struct("rank", "ord", "source", "priority")).alias("f")).select("site", "url", "f.*")
    order = Window.partitionBy("site").orderBy(F.desc("priority"), "rank", "ord", "url")
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= max_pages).drop("rank", "ord")
