"""Patterns of novelty are tried only where a text can match, and no match is lost by it."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import functions as F

from pagegauge.operators import pages


def _samples(pattern):
    """Texts that match: each choice of a group, by hand-made values for what is no letter."""
    text = pattern.removeprefix("(?i)").replace(r"\b", "")
    for old, new in ((r"\d[\d,]+", "1,000"), (r"[\d,]+", "12"), (r"\s+", "\t"), (".+", "people")):
        text = text.replace(old, new)
    while (group := re.search(r"\(([^()]*)\)(\??)", text)) and "|" not in group[1]:
        text = text.replace(group[0], group[1], 1)
    parts = re.split(r"(\([^()]*\))", text)
    if text.startswith("(") and not text.endswith(")") or text.count("(") > text.count("|"):
        return [text]
    return ["".join(p) for p in product(*(p.strip("()").split("|") if p.startswith("(") else [p] for p in parts))]


def test_a_match_holds_what_it_needs():
    for name, patterns in pages.NOVELTY.items():
        assert len(patterns) == len(pages.NOVELTY_NEEDS[name])
        for pattern, needs in zip(patterns, pages.NOVELTY_NEEDS[name], strict=True):
            for text in filter(re.compile(pattern).search, _samples(pattern)):
                assert any(n in re.search(pattern, text)[0].lower() for n in needs), (pattern, text)


def test_signals(spark):
    given = ["WE TESTED it", "However, so", "unlikely", "your data", "our  data", "Based on\t12 records", "personally", "the real problem", "a myth", "mythical", ""]
    rows = pages.information_gain(spark.createDataFrame([(i, t, "") for i, t in enumerate(given)], "i int, text string, html string"))
    got = {r["i"]: r["novelty"] for r in rows.collect()}
    want = {i: [n for n, ps in pages.NOVELTY.items() if any(re.search(p, t, re.ASCII) for p in ps)] for i, t in enumerate(given)}
    assert got == want and "lowered" not in rows.columns
    assert len(want[0]) == 2 and not want[2] and not want[3]
