"""Rows that share an id are judged one by one, however many blocks the benchmark has."""

from __future__ import annotations

import pytest

from pagegauge.llm import decontaminate

DIRTY = "alpha beta gamma"
DOCS = [(1, DIRTY), (1, "a clean text"), (None, DIRTY), (None, "another clean text"), (None, None), (2, "a clean text"), (2, "a clean text"), (3, DIRTY), (3, DIRTY)]


@pytest.mark.parametrize("block", [1 << 24, 10])
def test_rows_are_judged_one_by_one(spark, block):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([("z", DIRTY), ("b", DIRTY), ("c", DIRTY), ("d", "other words altogether")], "item_id string, text string")
    kept = [tuple(r) for r in decontaminate.decontaminate(docs, bench, block_bytes=block).collect()]
    assert sorted(kept, key=repr) == sorted([d for d in DOCS if d[1] != DIRTY], key=repr)
    judged = decontaminate.contamination(docs, bench, block_bytes=block).collect()
    assert len(judged) == len(DOCS) and {r["longest_item"] for r in judged if r["contaminated"]} == {"b"}
