"""The element tree of an HTML text, as column expressions: tags, texts between them, and for each element where it ends.

A page is cut into tags and the texts before, between and behind them. Comments, declarations, and scripts and styles with all they hold, are tags
without an element, so their content is no text. A fold over the tags keeps the open elements, the innermost first; a tag ends the innermost
open element of those that it ends, with all inside it, unless an element that guards it is met before (``_ends``): so unclosed
p, li, dt, td and the like end where a browser ends them, and a stray end tag ends nothing. A fold copies what it holds at each step, so it runs over blocks of
blocks of tags: no step copies more than a block's part, and work grows with the tags, not with their square.

Known differences from a browser's tree: formatting elements that are closed in the wrong order aren't opened again, nothing is moved out of tables, and an
element in more than ``MAX_DEPTH`` others isn't one (its text belongs to them).
"""

from __future__ import annotations

import html.entities
import json
import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH, BLOCK = 512, 64
#: More quoted values than this in one tag are not told apart: each costs a frame of the pattern's stack.
_QUOTES = 200
_ATTRIBUTES = rf"""[^"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'>]*+){{0,{_QUOTES}}}+[^>]*+>"""
#: A tag with all that belongs to it. What is opened and not closed takes the rest of the page.
TAG = rf"""(?is)<!--.*?(?:-->|\z)|<(?:script|style)(?=[\s/>]){_ATTRIBUTES}.*?(?:</(?:script|style)(?=[\s/>])[^>]*+>|\z)|</?[a-z]{_ATTRIBUTES}|<[!?/][^>]*+>"""

# Kinds of elements, as the HTML standard has them.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = (
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre",
    "search", "section", "summary", "table", "ul",
)
SCOPE = ("applet", "button", "caption", "html", "marquee", "object", "table", "td", "template", "th")
TABLE_PARTS = ("table", "caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th", "html", "body", "template")


def once(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it, and not copied, as a transformed array would be: a fold over nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, f)


def part(array: Column, start: Column, stop: Column) -> Column:
    """Items start to stop - 1, counted from 0, each taken by its number; ``slice`` walks to its start, which adds up over many parts."""
    return F.when(stop > start, F.transform(F.sequence(start, stop - 1), lambda i: F.get(array, i)))


def _names(*names: str) -> Column:
    """An array of names; one literal, that is split when the plan is made."""
    return F.split(F.lit(" ".join(names)), " ") if names else F.array().cast("array<string>")


#: Of the start tags that end elements: which names (the innermost of them ends), and those that guard what is outside them.
_STARTS = (
    (("li",), ("li",), ("ul", "ol", "menu", *SCOPE)), (("dd", "dt"), ("dd", "dt"), ("dl", *SCOPE)), (("td", "th"), ("td", "th"), ("tr", "table")), (("tr",), ("tr",), ("table",)), (("thead", "tbody", "tfoot"), ("thead", "tbody", "tfoot"), ("table",)),
    (("option", "optgroup"), ("option",), ("select", "datalist")), (("body",), ("head",), ()), (HEADINGS, ("p", *HEADINGS), (*SCOPE, *(b for b in BLOCKS if b != "p"), "li", "dd", "dt")), (BLOCKS, ("p",), SCOPE),
)
_RULES = {name: {"ends": ends, "guards": guards} for of, ends, guards in reversed(_STARTS) for name in of}


def _ends(name: Column, closes: Column) -> Column:
    """struct(ends, guards) of a tag; null if it ends nothing. An end tag ends its own name, or any heading; cells and the like guard what is outside them."""
    rule = F.from_json(F.lit(json.dumps(_RULES)), "map<string,struct<ends:array<string>,guards:array<string>>>")[name]
    ended = F.when(F.array_contains(_names(*HEADINGS), name), _names(*HEADINGS)).otherwise(F.array(name))
    guarded = F.when(F.array_contains(_names(*TABLE_PARTS), name), _names()).otherwise(_names(*SCOPE))
    return F.when(closes, F.struct(ended.alias("ends"), guarded.alias("guards"))).otherwise(rule)


def _step(s: Column, t: Column) -> Column:
    """The open elements (``names``, ``ids``, the innermost first) after a tag, and what the tag did."""
    hit = F.get(F.filter(s["names"], lambda n: F.array_contains(t["rule"]["ends"], n) | F.array_contains(t["rule"]["guards"], n)), F.lit(0))
    ended = once(F.when(t["rule"].isNotNull(), hit), lambda h: F.when(F.coalesce(F.array_contains(t["rule"]["ends"], h), F.lit(False)), F.array_position(s["names"], h).cast("int")).otherwise(0))

    def after(n: Column) -> Column:
        left = lambda a: F.when(n > 0, F.slice(a, n + 1, F.lit(MAX_DEPTH))).otherwise(a)
        return once(F.struct(left(s["names"]).alias("names"), left(s["ids"]).alias("ids")), lambda r: pushed(n, r))

    def pushed(n: Column, r: Column) -> Column:
        opens = t["opens"] & (F.size(r["ids"]) < MAX_DEPTH)
        did = F.struct(F.slice(s["ids"], F.lit(1), n).alias("closed"), F.size(r["ids"]).alias("level"), F.coalesce(F.get(r["ids"], F.lit(0)), F.lit(-1)).alias("parent"))
        put = lambda a, x: F.when(opens, F.array_prepend(a, x)).otherwise(a)
        return F.struct(put(r["names"], t["name"]).alias("names"), put(r["ids"], t["at"]).alias("ids"), F.array_append(s["done"], did).alias("done"))

    return once(ended, after)


def _folded(tags: Column) -> Column:
    """``names`` and ``ids`` of the elements open at the end, and what each tag did (``done``), by blocks of blocks of tags."""
    nothing = F.array().cast("array<struct<closed:array<int>,level:int,parent:int>>")
    state = lambda names, ids, done: F.struct(names.alias("names"), ids.alias("ids"), done.alias("done"))

    def over(names: Column, ids: Column, first: Column, last: Column, size: int) -> Column:
        if size == 1:
            return F.aggregate(F.coalesce(part(tags, first, last), F.array()), state(names, ids, nothing), _step)

        def block(s: Column, k: Column) -> Column:
            own = over(s["names"], s["ids"], first + k * size, F.least(first + (k + 1) * size, last), size // BLOCK)
            return once(own, lambda o: state(o["names"], o["ids"], F.concat(s["done"], o["done"])))

        blocks = F.when(last > first, F.sequence(F.lit(0), F.floor((last - first - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(blocks, state(names, ids, nothing), block)

    return over(_names(), F.array().cast("array<int>"), F.lit(0), F.size(tags), BLOCK * BLOCK)


def parsed(page: Column) -> Column:
    """struct(tags, texts, elements) of a page; a null page is empty.

    ``tags`` are the tags as they stand; ``texts``, one more than tags, are decoded. ``elements`` are struct(at, end, name, level, parent), in order: the numbers of
    the tag that begins and of the one that ends it (the number of tags if none does), its lower-case name, how many elements it is in, and the tag of
    the innermost of these (-1: none). A void element ends where it begins.
    """

    def cut(h: Column) -> Column:
        return once(F.struct(F.regexp_extract_all(h, F.lit(TAG), F.lit(0)).alias("tags"), F.transform(F.split(h, TAG, -1), decoded).alias("texts")), named)

    def named(x: Column) -> Column:
        facts = F.transform(x["tags"], lambda t, k: F.struct(k.alias("at"), F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1)).alias("name"), F.startswith(t, F.lit("</")).alias("closes")))
        ruled = F.transform(facts, rules)
        return once(ruled, lambda tags: once(_folded(tags), lambda f: whole(x, tags, f)))

    def rules(t: Column) -> Column:
        kind = lambda names: ~t["closes"] & F.array_contains(_names(*names), t["name"])
        opens = ~t["closes"] & (t["name"] != "") & ~kind((*VOID, "script", "style"))
        return F.struct(t["at"].alias("at"), t["name"].alias("name"), opens.alias("opens"), kind(VOID).alias("void"), _ends(t["name"], t["closes"]).alias("rule"))

    def whole(x: Column, tags: Column, f: Column) -> Column:
        closed = F.flatten(F.transform(f["done"], lambda d, k: F.transform(d["closed"], lambda i: F.struct(i.alias("at"), k.alias("end")))))
        left = F.transform(f["ids"], lambda i: F.struct(i.alias("at"), F.size(tags).alias("end")))
        void = F.transform(F.filter(tags, lambda t: t["void"]), lambda t: F.struct(t["at"].alias("at"), t["at"].alias("end")))
        fact = lambda e: F.struct(e["at"].alias("at"), e["end"].alias("end"), F.get(tags, e["at"])["name"].alias("name"), F.get(f["done"], e["at"])["level"].alias("level"), F.get(f["done"], e["at"])["parent"].alias("parent"))
        return F.struct(x["tags"].alias("tags"), x["texts"].alias("texts"), F.transform(F.sort_array(F.concat(closed, left, void)), fact).alias("elements"))

    return once(F.coalesce(page, F.lit("")), cut)


@lru_cache(maxsize=8)
def parsed_column(name: str) -> Column:
    """``parsed`` of a column; the expression is large and is put together once."""
    return parsed(F.col(name))


def text_between(tree: Column, at: Column, end: Column) -> Column:
    """All text behind tag ``at`` and before tag ``end``, white space collapsed, trimmed."""
    return squeezed(_joined(tree["texts"], at, end))


def _joined(texts: Column, at: Column, end: Column) -> Column:
    return F.coalesce(F.array_join(part(texts, at + 1, end + 1), ""), F.lit(""))


def text_of(tree: Column, element: Column) -> Column:
    return text_between(tree, element["at"], element["end"])


def raw_text(tree: Column, element: Column) -> Column:
    """Text of an element with its white space."""
    return _joined(tree["texts"], element["at"], element["end"])


def of_name(tree: Column, *names: str) -> Column:
    """The elements of these names."""
    return F.filter(tree["elements"], lambda e: e["name"].isin(*names))


def inside(elements: Column, outer: Column) -> Column:
    """Those of the elements that are in another one."""
    return F.filter(elements, lambda e: (e["at"] > outer["at"]) & (e["at"] < outer["end"]))


def text_without(tree: Column, outer: Column, *names: str) -> Column:
    """Text of an element without that of the elements of these names inside it."""
    cuts = inside(of_name(tree, *names), outer)

    def kept(cuts: Column) -> Column:
        # texts from the end of what was cut so far to the next cut; what is inside an earlier cut ends before and adds nothing
        zero = F.struct(outer["at"].alias("at"), F.array().cast("array<string>").alias("texts")).cast("struct<at:int,texts:array<string>>")
        piece = lambda a, b: _joined(tree["texts"], a, b)
        step = lambda s, c: F.struct(F.greatest(s["at"], c["end"]).alias("at"), F.when(c["at"] < s["at"], s["texts"]).otherwise(F.array_append(s["texts"], piece(s["at"], c["at"]))).alias("texts")).cast("struct<at:int,texts:array<string>>")
        return F.aggregate(cuts, zero, step, lambda s: squeezed(F.concat(F.array_join(s["texts"], ""), piece(s["at"], outer["end"]))))

    return once(cuts, kept)


# texts ---------------------------------------------------------------------------------------------------------------

#: What JavaScript counts as white space beyond ASCII, made blank once.
_SPACES = "[\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, _SPACES, " "), r"\s+", " "))


#: Names that may stand without a semicolon, the longest first.
_BARE = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_REFERENCE = rf"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|{_BARE})"
_USUAL = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: Bytes of the old Windows code page, which numeric references still mean.
_WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_NAMES = json.dumps(html.entities.html5)


def _named(name: Column) -> Column:
    """The signs of a name with its semicolon, or of a bare one; null if there is none."""
    return F.from_json(F.lit(_NAMES), "map<string,string>")[name]


def _numbered(code: Column) -> Column:
    known = F.from_json(F.lit(json.dumps(_WINDOWS)), "map<string,string>")[code.cast("string")]
    bad = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return F.coalesce(known, F.when(bad, "�").otherwise(F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")))


def _signs(ref: Column) -> Column:
    name = F.substring(ref, F.lit(2), F.length(ref))
    digits = F.rtrim(name, F.lit(";"))
    bare = F.regexp_extract(name, f"^({_BARE})", 1)
    number = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(digits, F.lit(3), F.length(digits)), 16, 10)).otherwise(F.substring(digits, F.lit(2), F.length(digits)))
    text = once(_named(name), lambda n: F.when(n.isNotNull(), n).when(bare != "", F.concat(_named(bare), F.substring(name, F.length(bare) + 1, F.length(name)))).otherwise(ref))
    return F.when(F.startswith(name, F.lit("#")), _numbered(F.when(F.length(digits) <= 10, number).try_cast("long"))).otherwise(text)


def plainly_decoded(text: Column) -> Column:
    """The usual character references replaced: enough for urls, classes and the like."""
    for code, sign in _USUAL:
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def decoded(text: Column) -> Column:
    """Character references replaced, each once; the usual ones without looking them up."""
    usual = plainly_decoded(text)
    known = "|".join(re.escape(code[1:]) for code, _ in _USUAL)
    odd = F.array_join(F.zip_with(F.split(text, _REFERENCE, -1), F.concat(F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), _signs), F.array(F.lit(""))), lambda gap, s: F.concat(gap, s)), "")
    return F.when(~F.contains(text, F.lit("&")), text).when(~text.rlike(rf"&(?!{known})[#A-Za-z]"), usual).otherwise(odd)
