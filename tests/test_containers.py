"""Which part of a page is its main content."""

from __future__ import annotations

import pytest

from pagegauge.functions import html as H
from pagegauge.operators import pages

PAGES = [
    ("<body><p>x</p><main><div>a</div></main><p>y</p></body>", "a", "a"),
    ("<body><div class='wide content page'><div>a</div> b</div> c</body>", "a b", "a b c"),
    ('<body>c <div id="content">a<div/>d</div> e</body>', "ad e", "c ad e"),
    ("<body><section ROLE=main>a<section>b</section>c</section>d</body>", "abc", "abc"),
    ("<body><div class='contents'>a</div>b</body>", "ab", "ab"),
    ("<body><div id='content'>a</div><article>b<article>c</article>d</article>e</body>", "a", "bcd"),
    ("<body><mainly>a</mainly><main>b", "b", "b"),
    ("<body>a<main></main></body>", "", ""),
    ("plain", "plain", "plain"),
    (None, "", ""),
]


@pytest.mark.parametrize("selectors, at", [(H.CONTAINERS, 1), (H.LANDMARKS, 2)])
def test_container(spark, selectors, at):
    df = spark.createDataFrame([(k, p[0]) for k, p in enumerate(PAGES)], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in pages.with_parts(df, selectors).select("page_id", "text").collect()}
    assert got == {k: p[at] for k, p in enumerate(PAGES)}
