"""Scores of platforms without their recommendations are the same scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegauge.operators import scoring
from pagegauge.plans.scoring import _ready


def test_scores_without_advice(spark, sf_dir):
    rows = _ready(spark, sf_dir).select(scoring.platform_readiness().alias("a"), scoring.platform_readiness(advise=False).alias("b"))
    of = lambda c: F.transform(c, lambda p: F.struct(p["platform"], p["score"], p["confidence"]))
    assert "recommendations" not in rows.schema["b"].dataType.elementType.names
    assert rows.where(of("a") != of("b")).isEmpty()
