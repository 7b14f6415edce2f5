"""Pages of a listing against offset paging."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from pagegauge.operators import listing


@pytest.fixture(scope="module")
def rows(spark):
    value = F.when(F.col("id") % 11 == 0, None).otherwise((F.col("id") * 37) % 53)
    return spark.range(430).select("id", value.alias("value")).repartition(5).cache()


@pytest.mark.parametrize("descending", [True, False])
def test_every_page(rows, descending):
    order = lambda r: (r["value"] is None, (-1 if descending else 1) * (r["value"] or 0), r["id"])
    want = sorted(rows.collect(), key=order)
    last = None
    for page in (1, 2, 3, 14, 15, 16):
        got = listing.numbered_page(rows, "value", F.floor(F.col("value") / 10), page, 29, descending).collect()
        assert got == want[(page - 1) * 29 : page * 29], page
    for page in range(1, math.ceil(len(want) / 60) + 2):
        got = listing.page_after(rows, "value", last, 60, descending).collect()
        assert got == want[(page - 1) * 60 : page * 60], page
        last = (got[-1]["value"], got[-1]["id"]) if got else last


def test_empty_listing(spark, rows):
    assert listing.numbered_page(rows.where("false"), "value", F.col("value"), 3).collect() == []
    assert listing.page_after(rows.where("false"), "value", (3, 1)).collect() == []


def test_only_the_bins_of_the_page_are_sorted(rows):
    plan = listing.numbered_page(rows, "value", F.floor(F.col("value") / 10), 9, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "FLOOR" in plan and "Filter" in plan
    first = listing.page_after(rows, "value", (20, 7), 20)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in first and "Exchange rangepartitioning" not in first
