"""The walk of JSON-LD blocks, and the analyzers that read it."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from pagegauge.functions import json_ld as J
from pagegauge.operators import json_ld, pages

AS_OF = "TIMESTAMP_NTZ '2024-01-31 00:00:00'"


def facts(spark, *blocks):
    return spark.createDataFrame([(list(blocks),)], "b array<string>").select(J.facts(F.col("b")).alias("f")).first()["f"]


def test_walk(spark):
    assert facts(spark, '{"@type":"X","items":[{"@type":"Y"}]}')["types"] == ["X"]
    got = facts(spark, '[{"@type":["A","B",3],"z":{"@type":"C","speakable":1}}, 5, null]', "{", " ", "null")
    assert (got["types"], got["n_objects"], got["n_bad"], got["speakable"]) == (["A", "B", "C"], 1, 1, True)
    got = facts(spark, '{"@graph":[{"@type":"P","x":{"@type":"Q"}},[{"@type":"R"},[{"@type":"S"}]]],"@type":"O"}')
    assert got["types"] == ["O", "P", "Q", "R"] and [i["top"] for i in got["items"]] == [True, False]
    assert spark.createDataFrame([(None,)], "b array<string>").select(J.facts(F.col("b")).alias("f")).first()["f"]["n_objects"] == 0


def test_deep_blocks(spark):
    nested = {"@type": "Z", "speakable": 1}
    for _ in range(450):
        nested = {"a": [nested]}
    got = facts(spark, '{"a":' * 100_000 + "1" + "}" * 100_000, '{"@type":"X"}', json.dumps(nested))
    assert (got["types"], got["n_bad"], got["speakable"]) == (["X"], 1, True)


def test_items(spark):
    got = facts(spark, '{"author":{"name":"Ann","jobTitle":"x"},"description":"d","headline":7,"offers":{},"aggregateRating":{"ratingValue":"7"},"@type":"Product"}')["items"][0]
    assert (got["type"], got["author"], got["author_name"], got["author_credits"], got["headline"], got["has_offers"], got["rating"], got["best"]) == ("Product", "Ann", "Ann", True, "7", True, 7.0, 5.0)


def _page(spark, *blocks, html="<body></body>"):
    page = "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks) + html
    return pages.with_parts(spark.createDataFrame([(1, "https://a.com/x", page)], "page_id int, url string, html string"))


def test_type_behind_a_long_text(spark):
    rows = _page(spark, json.dumps({"description": "word " * 20_000, "author": {"@type": "Event"}, "@type": "Product"}))
    assert rows.select(pages.page_type(F.col("tree"), F.col("ld"))).first()[0] == "product"
    assert _page(spark, '{"@graph":[{"@type":"Product"}]}').select(pages.page_type(F.col("tree"), F.col("ld"))).first()[0] == "homepage"


def test_person_of_a_graph(spark):
    rows = _page(spark, '{"@graph":[{"name":"Bo Dean","description":"Writes","knowsAbout":["x"],"@type":"Person"}]}')
    got = pages.author_trust(pages.dates_and_author(pages.links_of(rows), F.expr(AS_OF))).first()
    assert (got["author"], got["has_bio"], got["has_credentials"]) == ("Bo Dean", True, True)


def test_shown_authors(spark):
    page = "<div class='author-box'>By <a href='/ann'>Ann Lee</a><div>" + "and more " * 10 + "<p class='author-bio'>" + "She is a certified diver. " * 3 + "</p></div></div>"
    rows = _page(spark, html=page)
    got = pages.author_trust(pages.dates_and_author(pages.links_of(rows), F.expr(AS_OF))).first()
    assert (got["author"], got["has_bio"], got["has_credentials"]) == ("Ann Lee", True, True)


def test_organization_in_any_order(spark):
    rows = _page(spark, '{"logo":{"@type":"ImageObject"},"@type":"Organization"}')
    assert pages.entities(rows).first()["entity_score"] == pages.entities(_page(spark, '{"@type":"Thing"}')).first()["entity_score"] + 10


def test_faq_counts_main_entities(spark):
    got = pages.faq(_page(spark, '{"@type":"FAQPage","mainEntity":[{},{},{}]}', '{"@graph":[{"@type":"FAQPage","mainEntity":[1]}]}', '{"@type":"Thing","mainEntity":[1,2]}')).first()
    assert (got["faq_schema"], got["faq_questions"], got["faq_score"]) == (True, 3, 35)


def test_credentials_far_into_the_author_section(spark):
    def signals(said):
        page = "<body><p>" + "medical doctor treatment words here " * 5 + "</p><div class='author'>" + "filler " * 200 + said + "</div></body>"
        return pages.sensitivity(pages.links_of(_page(spark, html=page))).first()["present"]

    assert "authorCredentials" in signals("Ann Lee, PhD") and "authorCredentials" in signals("seen by Dr.Lee") and "authorCredentials" not in signals("Dr. Lee")


def test_accuracy_of_a_bad_block(spark):
    got = json_ld.schema_accuracy(_page(spark, "{"), F.expr(AS_OF)).first()
    assert (got["n_issues"], got["accuracy_score"]) == (1, 95)
