"""Sitemaps of large hosts are several rows, and every child of an index is listed."""

from __future__ import annotations

from pagegauge.plans import pages
from pagegauge.sources import readers


def test_runs_and_children(spark, tmp_path):
    rows = [(i, f"https://a.org/{i}") for i in range(10)] + [(i, f"https://b.org/{i}") for i in range(10, 12)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    maps = pages._sitemaps(spark, str(tmp_path), 3)
    assert maps.count() == 5 and maps.select("sitemap_url").distinct().count() == 5
    assert sorted(r["url"] for r in readers.sitemap_urls(maps).collect()) == sorted(u for _, u in rows)
    assert pages.io5_child_sitemaps(spark, str(tmp_path)).count() == 12
