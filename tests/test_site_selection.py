"""Budgets of large sites, means of open sub-score keys, and stored JSON of any kind."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagegauge.operators import sites
from pagegauge.sources import readers


def _bins():
    return [F.coalesce(-F.col("score"), F.lit(1)), F.floor(F.col("id") / 512)]


def test_budget_of_a_hot_site(spark):
    """Two hundred thousand pages of one site, most of one score, beside small sites and rows without a site or a score."""
    n = 200_000
    hot = spark.range(n).select(F.lit("hot").alias("site"), "id", F.when(F.col("id") % 7 == 0, F.col("id") % 101).otherwise(50).cast("int").alias("score"), F.lit(60_000).alias("budget"))
    small = spark.createDataFrame([("a", 1, 5, 2), ("a", 2, None, 2), ("a", 3, 9, 2), ("b", 1, 1, 0), (None, 1, 3, 1), (None, 2, 4, 1), ("c", 1, None, 5)], "site string, id long, score int, budget int")
    pages = hot.unionByName(small)
    order = [F.desc("score"), F.col("id")]
    got = sites.within_budget(pages, "site", _bins(), order, F.col("budget"))
    want = pages.withColumn("position", F.row_number().over(Window.partitionBy("site").orderBy(*order))).where("position <= budget")
    assert got.columns == want.columns
    assert got.count() == want.count() == 60_000 + 2 + 1 + 1 and got.exceptAll(want).isEmpty()
    # no window holds a site: bins are sorted apart
    largest = pages.where("site = 'hot'").groupBy(*_bins()).count().agg(F.max("count")).first()[0]
    assert largest <= 512


def test_means_of_keys_that_no_list_names(spark):
    rows = [(1, {"feed": 10.0, "new": 7.0}), (1, {"feed": 21.0}), (1, {}), (2, {"other": None}), (None, {"feed": 1.0}), (3, None)]
    df = spark.createDataFrame(rows, "project_id long, sub_scores map<string,double>")
    got = {(r["project_id"], r["sub_score"]): r["average"] for r in sites.sub_score_means(df).collect()}
    assert got == {(1, "feed"): 10, (1, "new"): 2, (2, "other"): 0, (None, "feed"): 1}


def test_stored_json(spark):
    texts = ['{"feed": 40, "x": 1.5, "s": "7", "b": true, "n": null, "o": {"a": 1}, "l": [1]}', "{broken", "[1]", "null", "", None, '{"allowsGPTBot": false, "exists": true}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, json string")
    got = df.orderBy("id").select(readers.parsed_scores(F.col("json")).alias("scores"), readers.parsed_flags(F.col("json")).alias("flags")).collect()
    assert [r["scores"] for r in got] == [{"feed": 40.0, "x": 1.5}, {}, {}, {}, {}, {}, {}]
    assert [r["flags"] for r in got] == [{"b": True}, {}, {}, {}, {}, {}, {"allowsGPTBot": False, "exists": True}]


def test_reasons_of_rejected_entities(spark):
    from pagegauge.sources.entities import judged_entities

    good = '{"id":"1","user_id":"u","organization_id":"o","role":"owner"}'
    texts = [good, "{", "[1]", "5", '{"id":null,"user_id":7,"role":{"a":1},"zeta":1,"more":2}', None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "n int, value string")
    got = {r["n"]: [tuple(x) for x in r["reasons"]] for r in judged_entities(df, "org_members").collect()}
    assert got[0] == [] and got[1] == [("", "no JSON")] and got[2] == got[3] == [("", "no object")] and got[5] == [("", "no JSON")]
    assert [x for x in got[4] if x[1] in ("lacking", "unknown")] == [("id", "lacking"), ("organization_id", "lacking"), ("more", "unknown"), ("zeta", "unknown")]
