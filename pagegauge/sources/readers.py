"""Reading raw inputs: log text, fetched pages, sitemaps, robots files, stored JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_HTML = 5 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer pieces (a small table in one file), for work that costs much a row; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def log_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """IO2: lines of an access log that are not empty."""
    return lines.where(F.length(value) > 0)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return log_rows(spark.read.text(path))


def reject_reason(status: Column, content_type: Column, html: Column) -> Column:
    """IO3: why a fetched page is not admitted; null if it is."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(status.between(300, 399), "redirect_not_followed")
        .when(~F.coalesce(status.between(200, 299), F.lit(False)), "http_error")
        .when((kind != "") & ~F.contains(kind, F.lit("text/html")) & ~F.contains(kind, F.lit("application/xhtml")), "not_html")
        .when(F.length(F.coalesce(html, F.lit(""))) > MAX_HTML, "too_large")
    )


def admitted(pages: DataFrame) -> DataFrame:
    return pages.withColumn("reject_reason", reject_reason(F.col("status"), F.col("content_type"), F.col("html")))


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """IO4: (site, url, priority) of each <loc>; only a <priority> right behind it counts, else 0.5."""
    entry = r"<loc>\s*([^<]+?)\s*</loc>(?:\s*<priority>\s*([^<]*?)\s*</priority>)?"
    each = F.arrays_zip(F.regexp_extract_all("xml", F.lit(entry), F.lit(1)).alias("url"), F.regexp_extract_all("xml", F.lit(entry), F.lit(2)).alias("priority"))
    rows = sitemaps.select("site", "sitemap_url", F.posexplode(each).alias("ord", "e"))
    priority = F.coalesce(F.col("e.priority").try_cast("double"), F.lit(0.5))
    return rows.select("site", "sitemap_url", "ord", F.col("e.url").alias("url"), F.when(F.isnan(priority), 0.5).otherwise(priority).alias("priority"))


def child_sitemaps(sitemaps: DataFrame, limit: int | None = 5) -> DataFrame:
    """IO5: the first ``limit`` sitemaps that a sitemap index names, or all."""
    locs = F.regexp_extract_all("xml", F.lit(r"<sitemap>\s*<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))
    return sitemaps.select("site", F.posexplode(locs if limit is None else F.slice(locs, 1, limit)).alias("ord", "child_url"))


def robots_sitemaps(robots: Column) -> Column:
    """IO6: the sitemap urls of a robots.txt."""
    return F.transform(F.regexp_extract_all(robots, F.lit(r"(?im)^sitemap:[ \t]*(\S[^\r\n]*)$"), F.lit(1)), lambda u: F.trim(u))


FIX = "struct<description:string,points:int,layer:string,factorId:string,priority:int>"


def parsed_fixes(json: Column) -> Column:
    """IO7: the well-formed fixes of a stored JSON value; anything else gives an empty array."""
    raw = F.from_json(json, "array<struct<description:string,points:string,layer:string,factorId:string,priority:string>>")
    number = lambda x: x.try_cast("int")
    good = F.filter(F.coalesce(raw, F.array().cast("array<struct<description:string,points:string,layer:string,factorId:string,priority:string>>")), lambda f: f["description"].isNotNull() & number(f["points"]).isNotNull() & f["layer"].isin("access", "understanding", "extractability") & f["factorId"].isNotNull() & number(f["priority"]).isNotNull())
    return F.transform(good, lambda f: F.struct(f["description"], number(f["points"]), f["layer"], f["factorId"], number(f["priority"])).cast(FIX))


def parsed_scores(json: Column) -> Column:
    """IO7: the numbers of a stored JSON object by key, whatever the keys (sub-scores, layer scores); other values of it are left out, and anything else gives an empty map."""
    values = lambda v: F.map_filter(F.transform_values(F.coalesce(v, F.create_map().cast("map<string,variant>")), _number), lambda _, x: x.isNotNull())
    return values(F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>"))


def _number(key: Column, value: Column) -> Column:
    # a schema of scalars is a word; of text and truth values that read as numbers none is taken
    return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(value, "$", "double"))


def parsed_flags(json: Column) -> Column:
    """IO7: the truth values of a stored JSON object by key (what a robots.txt allows)."""
    flag = lambda _, v: F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
    values = F.coalesce(F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.map_filter(F.transform_values(values, flag), lambda _, x: x.isNotNull())
