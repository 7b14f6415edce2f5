"""Names and entities of a site against all pairs."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagegauge.operators import entities

R = random.Random(5)
WORDS = ["acme", "acm", "beta", "me", "a", "", "corp", "Beta Corp", "ACME, corp", "x" * 30]
PAGES = [(f"s{k % 3}", f"u{k}", [R.choice(WORDS)], [R.choice(WORDS)], [R.choice("abcdefgh") for _ in range(R.randint(0, 4))]) for k in range(60)] + [("one", "u", ["acme"], [None], None)]
SCHEMA = "site string, url string, organization_names array<string>, author_names array<string>, top_entities array<string>"


def norm(name):
    return re.sub("[^a-z0-9]+", " ", name.lower()).strip()


def variants(names):
    out = set()
    for a, b in itertools.combinations(sorted(set(names)), 2):
        if norm(a) == norm(b):
            out |= {a, b}
        elif norm(a) in norm(b) or norm(b) in norm(a):
            out |= {min(x for x in names if norm(x) == norm(c)) for c in (a, b)}
    return out


def test_variants_and_pages(spark):
    df = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    found = entities.name_variants(df, "organization_names")
    expected = {(s, v) for s in {p[0] for p in PAGES} for v in variants([n for p in PAGES if p[0] == s for n in p[2]])}
    assert {tuple(r) for r in found.collect()} == expected
    used = {(s, u) for s, u, names, *_ in PAGES for n in names for t, v in expected if s == t and (norm(n) in norm(v) or norm(v) in norm(n))}
    assert {tuple(r) for r in entities.affected_pages(df, found, "organization_names").collect()} == used


def test_ranges_of_names(spark):
    """Every way to deal names to ranges finds the same."""
    df = spark.createDataFrame(PAGES, SCHEMA).select("site", F.explode("organization_names").alias("norm"))
    for equal in (True, False):
        want = set()
        for s, names in {s: {n for p in PAGES if p[0] == s for n in p[2]} for s in {p[0] for p in PAGES}}.items():
            for a, b in itertools.product(names, names):
                if b in a and (equal or a != b):
                    want |= {(s, a, True), (s, b, False)}
        for size in (100_000, 3, 1):
            assert {tuple(r) for r in entities.containment(df, df, equal, size).collect()} == want


def test_many_names_with_one_beginning(spark):
    n = 100_000
    forms = spark.range(n).select(F.lit("s").alias("site"), F.concat(F.lit("acme "), F.format_string("%06d", "id")).alias("norm"))
    more = forms.union(spark.createDataFrame([("s", "big acme 000007 corp"), ("s", "acme 0000")], "site string, norm string"))
    got = entities.containment(more, more, equal=False, size=30_000).groupBy("holds").count().collect()
    # acme 0000 is in a hundred of the names and in the long one; the long one holds it and acme 000007
    assert {r["holds"]: r["count"] for r in got} == {True: 101, False: 2}


def test_overlap(spark):
    for tile in (entities.TILE, 4, 1):
        got = {r["site"]: (r["pages"], r["overlap"]) for r in entities.entity_overlap(spark.createDataFrame(PAGES, SCHEMA), tile=tile).collect()}
        for site in {p[0] for p in PAGES}:
            sets = [{norm(e) for e in p[4] or []} for p in PAGES if p[0] == site]
            each = [len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2) if a | b]
            assert got[site] == (len(sets), math.floor(sum(each) / len(each) * 100 + 0.5) if each else 50)


def test_sum_of_a_tile_pair():
    rng = np.random.default_rng(3)
    for n_a, n_b, vocabulary in ((40, 30, 15), (1_500, 200, 400), (5, 5, 10_000)):
        sets = [[np.unique(rng.integers(0, vocabulary, rng.integers(1, 12))) for _ in range(n)] for n in (n_a, n_b)]
        counts = [rng.integers(1, 5, n) for n in (n_a, n_b)]
        a, b = (entities._tile(pa.table({"items": pa.array([x.tolist() for x in s], pa.list_(pa.int64())), "c": c})) for s, c in zip(sets, counts, strict=True))
        jaccard = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        if n_a * n_b < 10_000:
            want = sum(counts[0][i] * counts[1][j] * jaccard(x, y) for i, x in enumerate(sets[0]) for j, y in enumerate(sets[1]))
            assert entities._block_sum(a, b, False) == pytest.approx(want)
            want = sum(counts[0][i] * counts[0][j] * jaccard(sets[0][i], sets[0][j]) for i in range(n_a) for j in range(i + 1, n_a))
            assert entities._block_sum(a, a, True) == pytest.approx(want)
        else:  # over several blocks of rows
            assert entities._block_sum(a, b, False) == pytest.approx(entities._block_sum(b, a, False))


def test_overlap_of_a_large_site(spark):
    """A site of 100,000 distinct sets: two entities that all have, one of a thousand, and one of their own."""
    n = 100_000
    own = F.array(F.lit("all"), F.lit("each"), F.concat(F.lit("group "), (F.col("id") % 1_000).cast("string")), F.concat(F.lit("own "), F.col("id").cast("string")))
    pages = spark.range(n).select(F.lit("s").alias("site"), own.alias("top_entities"))
    got = entities.entity_overlap(pages, tile=1 << 17).first()
    same, other = n / 1_000 - 1, n - n / 1_000
    assert (got["pages"], got["overlap"]) == (n, math.floor((same * 3 / 5 + other * 2 / 6) / (n - 1) * 100 + 0.5))
