"""The pipeline against plain versions of its stages, each on what the stage before kept."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from pagegauge.llm import language_id, line_dedup, queries
from pagegauge.llm.tables import read

from . import brute


def test_run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    trees = language_id.learn(docs, ~language_id.held_out(F.col("doc_id")))
    kept = {r["doc_id"] for r in language_id.identify(docs, trees).where("lang_pred <> 'und'").collect()}
    # tests/llm/test_line_links.py holds the lines themselves against the edit distance
    gone = {r["doc_id"]: r["removed"] for r in line_dedup.line_marks(docs.where(F.col("doc_id").isin(*kept))).collect()}
    texts = brute.without_lines([(i, rows[i]["text"]) for i in sorted(kept)], gone)
    groups = brute.similar(list(texts.items()))
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    items = [(r["item_id"], r["text"]) for r in read(spark, sf_dir, "benchmark").collect()]
    dirty = brute.contamination(list(texts.items()), items)
    texts = {i: t for i, t in texts.items() if not dirty[i][4]}
    domain = {r["doc_id"]: r["d"] for r in docs.select("doc_id", queries.domain_of(F.col("source")).alias("d")).collect()}
    taken = brute.mixing([(i, domain[i], rows[i]["lang"], rows[i]["source"], len(brute.BLANK.findall(t))) for i, t in texts.items()], corpus_pipeline.SHARE, corpus_pipeline.MAX_EPOCHS, 7, queries.WEIGHTS)
    got = {(r["doc_id"], r["epoch"]): (r["taken"], r["text"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {k: v[0] for k, v in got.items()} == taken
    for (i, _), (n, text) in got.items():
        words = brute.BLANK.findall(texts[i])
        assert text == texts[i] if n == len(words) else text == " ".join(words[:n])


def test_stages_keep_the_columns(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
