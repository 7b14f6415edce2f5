"""Bounds and distance of two lines against the plain edit distance, and what the bounds spare."""

from __future__ import annotations

import random

import pyarrow as pa

from pagegauge.llm import line_dedup, token_alignment
from pagegauge.llm.edits import at_least, signs, within

from . import brute

R = random.Random(5)


def changed(text: str, times: int) -> str:
    out = list(text)
    for _ in range(times):
        i = R.randint(0, len(out))
        out[i : i + R.randint(0, 1)] = R.choice(["", "a", "é", " ", "b c"])
    return "".join(out)


def test_within_is_the_edit_distance():
    for n in (0, 1, 7, 30, 80):
        for _ in range(120):
            a = "".join(R.choices("abcé 日", k=n))
            b = changed(a, R.randint(0, 10)) if R.random() < 0.8 else "".join(R.choices("abcé 日", k=n))
            d = brute.edits(a, b)
            assert [within(a, b, k) for k in (d, d + 3)] == [True, True] and (d == 0 or not within(a, b, d - 1))
            low = at_least(signs(pa.array([a, "x"])), signs(pa.array([b, "x"])))
            assert low[0] <= d and low[1] == 0


def test_counts_above_a_byte_are_still_a_bound():
    a, b = "e" * 1000, "e" * 990 + "a" * 10
    assert at_least(signs(pa.array([a])), signs(pa.array([b])))[0] <= brute.edits(a[-20:], b[-20:])


def lines_of_one_key() -> list[tuple[int, str]]:
    return [(i, "the same three words " + chr(97 + i) * 40) for i in range(26)]


def test_unlike_lines_of_a_key_need_no_texts(spark, monkeypatch):
    wanted, texts = [], line_dedup._texts
    monkeypatch.setattr(line_dedup, "_texts", lambda docs, w: wanted.append(w.count()) or texts(docs, w))
    docs = spark.createDataFrame(lines_of_one_key(), "doc_id long, text string")
    assert line_dedup.line_marks(docs).count() == 0
    assert wanted == [0]


def test_rounds_of_pairs_find_the_same(spark, monkeypatch):
    rows = [(i, f"this line is met again with a change {'xyz'[i % 3]} in it for group {'abcdefgh'[i // 3] * 12}") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = line_dedup.line_marks(docs).collect()
    monkeypatch.setattr(line_dedup, "LEAST_PAIRS", 1)
    assert sorted(line_dedup.line_marks(docs).collect()) == sorted(expected) and len(expected) == 16


def test_picked_of_none_one_and_more():
    assert [token_alignment._picked(i, [b"a", b"b"]) for i in ([], [1], [1, 0, 1])] == [(), (b"b",), (b"b", b"a", b"b")]
