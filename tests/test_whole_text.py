"""Authors and forms of address count wherever in the text they stand."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegauge.operators import json_ld, pages


def _parts(spark, end: str, head: str = ""):
    html = f"{head}<body><h1>Title</h1><div>{'plain filler words ' * 300}{end}</div></body>"
    return pages.with_parts(spark.createDataFrame([(1, html)], "page_id int, html string"))


def test_author_at_the_end(spark):
    head = '<script type="application/ld+json">{"headline":"Title","author":"Bob Roe"}</script>'
    count = lambda end: json_ld.hallucination_risk(json_ld.with_json_ld(_parts(spark, end, head)), F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")).first()["inconsistencies"]
    assert (count("by Bob Roe"), count("by nobody")) == (0, 1)


def test_address_at_the_end(spark):
    score = lambda end: pages.conversational(_parts(spark, end)).first()["conversation_score"]
    assert score("this is for you too") == score("this is for them too") + 20
