"""The trigram index against the regular expressions alone, over constructs that the derivation knows and does not know."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pagegauge.llm import secret_scan, substring_dedup
from pagegauge.llm.secret_scan import Rule

PATTERNS = (
    r"key(?!test)[0-9]+", r"(?!foobar)abcx?", r"(?<name>abc)d", r"(a)b\1c", r"\Qa|b\Ecd", r"[a-z&&[^b]]xyz", r"ab+?cde", r"(?i)SeCret", r"abc|def(?=ghi)", r"\p{L}abc", r"(?x) a b c d", r"foo\.bar", r"a{2,3}bcd", r"Abcd", r"(?i:Key)[0-9]{2}",
    r"(?:abc)?+def", r"x(?:abc|de)*+yz1", r"\bword\b", r"caf\x65s", r"éclair", r"(?<=key)123", r"a(?:b(?:c|d)|e)fgh", r"(?-i:abc)", r"[\]x]yz", r"^abc", r"\d{3}-foo", r"abc{0}def", r"ab.cd\tx",
)
PIECES = [
    "key123", "keytest1", "abc", "abcd", "abac", "a|bcd", "axyz", "bxyz", "abbcde", "SECRET", "secret", "defghi", "Labc", "foo.bar", "fooxbar", "aabcd", "aaabcd", "Abcd", "KEY42", "def", "xabcdeyz1", "xyz1", " word ", "cafes", "éclair", "ÉCLAIR", "abcfgh", "abdfgh",
    "aefgh", "]yz", "123-foo", "abdef", "ab-cd\tx", " ", "\n", "foobar", "a b c d", "Abcd",
]


def test_unknown_constructs_scan_fully():
    for pattern in (PATTERNS[k] for k in (0, 1, 2, 3, 4, 5, 8, 9, 10, 20, 22)):
        assert secret_scan.trigram_query(pattern) == [], pattern
    assert secret_scan.trigram_query(r"ab+?cde") == [frozenset({"cde"})] and secret_scan.trigram_query("(?:abc)?+def") == [frozenset({"def"}), frozenset({"abc", "bcd", "cde", "def"})]
    assert secret_scan.trigram_query("éclair") == [frozenset({"cla", "lai", "air"})]


def test_every_construct_finds_what_the_pattern_finds(spark):
    rng = random.Random(9)
    rows = [(k, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12)))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()
    rules = tuple(Rule(f"r{k}", p) for k, p in enumerate(PATTERNS))
    got = {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in secret_scan.find_secrets(docs, rules).collect() for s in r["spans"]}
    alone = set()
    for r in rules:
        for row in docs.select("doc_id", "text", F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("hits"), F.split("text", r.pattern, -1).alias("gaps")).collect():
            at = 0
            for gap, hit in zip(row["gaps"], row["hits"]):
                alone.add((row["doc_id"], r.kind, at + len(gap), at + len(gap) + len(hit)))
                at += len(gap) + len(hit)
    assert got == alone and {k for _, k, _, _ in alone} >= {f"r{k}" for k in range(10)}


@pytest.mark.parametrize("block", [2, 1 << 16])
def test_lists_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(secret_scan, "BLOCK_ROWS", block)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["abcd", "abc", "bcd", "xabcx abcdx", "", "wxyz", "wxy xyz", "abcd"])], "row long, text string")
    rules = (Rule("one", "abcd"), Rule("two", "wxyz|bcd"))
    index = secret_scan.postings(rows, rules)
    assert {r["trigram"] for r in index.collect()} == {"abc", "bcd", "wxy", "xyz"} and all(len(r["rows"]) <= block for r in index.collect())
    got = {r["row"]: sorted(r["kinds"]) for r in secret_scan.candidates(index, rules).collect()}
    assert got == {0: ["one", "two"], 2: ["two"], 3: ["one", "two"], 5: ["two"], 6: ["two"], 7: ["one", "two"]}


def test_rules_without_trigrams_alone(spark):
    docs = spark.createDataFrame([(1, "ab 12"), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: len(r["spans"]) for r in secret_scan.find_secrets(docs, (Rule("n", "[0-9]"),)).collect()}
    assert got == {1: 2, None: 0}


def test_repeats_are_the_same_under_every_partitioning(spark):
    """Numbers of rows are written: how rows come to their tasks changes nothing."""
    words = [f"w{k % 97}" for k in range(400)]
    rows = [(k % 23 if k % 5 else None, " ".join(words[k : k + 60])) for k in range(60)]
    results = []
    for n in (1, 3, 7):
        done = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()
        results.append(sorted(map(repr, done)))
    assert results[0] == results[1] == results[2]
