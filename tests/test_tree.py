"""The element tree against one built from Python's own tokenizer, and its growth with the page."""

from __future__ import annotations

import html
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagegauge.functions import tree as T
from pagegauge.operators import pages

ENDS = {name: (set(rule["ends"]), set(rule["guards"])) for name, rule in T._RULES.items()}


class Plain(HTMLParser):
    """Elements as [name, depth, text], from a stack of open ones."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.open, self.elements = [], []
        self.feed(page)
        self.close()

    def end(self, ends, guards):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in ends:
                del self.open[k:]
                return
            if self.open[k][0] in guards:
                return

    def handle_starttag(self, tag, attrs):
        self.end(*ENDS.get(tag, ((), ())))
        if tag in ("script", "style"):
            return
        element = [tag, len(self.open), ""]
        self.elements.append(element)
        if tag not in T.VOID:
            self.open.append(element)

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        self.end(T.HEADINGS if tag in T.HEADINGS else (tag,), () if tag in T.TABLE_PARTS else T.SCOPE)

    def handle_data(self, data):
        if self.rawdata and self.cdata_elem:
            return
        for e in self.open:
            e[2] += data


def plain(page):
    return [(name, depth, " ".join(text.split())) for name, depth, text in Plain(page).elements]


PAGES = [
    "<div>a<div>b<div>c</div>d</div>e</div>f",
    "<ul><li>a<ul><li>b</li><li>c</ul><li>d</ul><section>x<section>y</section>z</section>",
    "<p>one<p>two <b>bold<p>three<div>four<p>five</div>six",
    '<p title="a > b" class=\'x>y\'>text</p><a href="?a=1&amp;b=2">link</a>',
    "<p>&#8217;quoted&#x2019; &amp;lt; &eacute;&hellip;&nbsp;&copy 2024 &notit; &#150; &#0; &#xD800; &unknown; AT&T</p>",
    "<dl><dt>a<dd>b<dt>c<dd>d</dl><table><tr><td>1<td>2<tr><td>3<table><tr><td>in</table></table>after",
    "<h2>a<h3>b</h2>c</h3><p>d<h1>e</h1>",
    "<body><p>a</div>b</p></span>c</body>",
    "<script>var t = '</p><p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes<br>and<img src=x>more",
    "<select><option>a<option>b</select><P>UPPER<DIV/>self</P>",
    "<td>x</b>y</td><button><p>in</button>out",
    "", "no tags at all & more", "<p", "a<b",
]


def elements(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, html string").withColumn("tree", T.parsed(F.col("html")))
    got = df.select("id", F.transform("tree.elements", lambda e: F.struct(e["name"], e["level"], T.text_of(F.col("tree"), e))).alias("x")).collect()
    return {r["id"]: [tuple(x) for x in r["x"]] for r in got}


def test_trees(spark):
    got = elements(spark, PAGES)
    for k, page in enumerate(PAGES):
        want = plain(page) if page not in ("<p", "a<b") else []
        assert got[k] == want, page


def test_random_trees(spark):
    rng = random.Random(7)
    names = ["p", "li", "ul", "div", "b", "h2", "td", "tr", "table", "section", "dd", "dt", "br", "button", "option"]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 200)):
            n = rng.choice(names)
            parts.append(rng.choice([f"<{n}>", f"</{n}>", f'<{n} a="x>y" b=\'<i>\'>', f"w{rng.randint(0, 9)} ", "&amp;", "&#8217;"]))
        texts.append("".join(parts))
    got = elements(spark, texts)
    for k, page in enumerate(texts):
        assert got[k] == plain(page), page


def test_references(spark):
    texts = [f"&{n}x" for n in html.entities.html5][::7] + ["&#1114112;", "&#99999999999999999999;", "&#x1F600;", "&amp", "&ampx;", "&;", "&#;", "&#x;", "plain"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(T.decoded(F.col("t"))).collect()]
    assert got == [html.unescape(t) for t in texts]


def test_deep_and_null_pages(spark):
    got = elements(spark, ["<div>" * 2_000 + "x", None])
    assert len(got[0]) == T.MAX_DEPTH and got[0][0] == ("div", 0, "x") and got[1] == []


def test_many_quotes(spark):
    page = "<p " + " ".join(f'a{k}="v"' for k in range(20_000)) + ">x</p>"
    assert elements(spark, [page])[0] == [("p", 0, "x")]


def test_time_grows_with_the_page(spark):
    def seconds(n):
        page = "<div>" + "".join(f'<p class="c{k}">text {k} <b>bold</b>' for k in range(n)) + "</div>"
        df = spark.createDataFrame([(page,)], "html string").withColumn("tree", T.parsed(F.col("html")))
        began = time.time()
        row = df.select(F.size(F.filter(F.transform(T.of_name(F.col("tree"), "p"), lambda e: T.text_of(F.col("tree"), e)), lambda t: t != ""))).first()
        assert row[0] == n
        return time.time() - began

    seconds(1_000)
    small, large = seconds(25_000), seconds(100_000)  # some 1 and 4 MB
    assert large < 60 and large < 12 * max(small, 1.0)


@pytest.mark.parametrize("cut, words", [("nav", "a b d e"), ("", "a b c d e")])
def test_text_without(spark, cut, words):
    page = "<main>a <p>b</p> <nav>c<nav>c</nav></nav> d e</main>" if cut else "<main>a b <nav>c</nav> d e</main>"
    tree, names = F.col("tree"), [cut] if cut else ["footer"]
    row = spark.createDataFrame([(page,)], "html string").withColumn("tree", T.parsed(F.col("html"))).select(T.once(F.get(T.of_name(tree, "main"), F.lit(0)), lambda e: T.text_without(tree, e, *names))).first()
    assert row[0] == words


def test_sections_are_of_the_containers_own_children(spark):
    page = "<main><p>before all</p><h2>A</h2><p>one</p><ul><li>two</li></ul><div><h2>inner</h2>three</div><h3>B</h3><p>four</p></main>"
    rows = pages.with_parts(spark.createDataFrame([(1, page)], "page_id int, html string"))
    assert pages.quality(rows.withColumn("keep", F.lit(1))).first()["front_loaded"] == 0
    assert pages.sections_of(rows).first()["sections"] == ["before all", "one two innerthree", "four"]
