"""Facts of a page as column expressions over its tree: the main content, texts of elements, attributes of tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tree as T
from .tree import decoded, once, plainly_decoded

_HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def visible(html: Column) -> Column:
    """Without scripts, styles and comments."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "")


# What can hold a page's main content.
LANDMARKS = ("main", "article", '[role="main"]')
CONTAINERS = (*LANDMARKS, ".content", "#content")
_SPAN = "struct<at:int,end:int>"


def _span(element: Column) -> Column:
    return F.struct(element["at"].alias("at"), element["end"].alias("end")).cast(_SPAN)


def whole(tree: Column) -> Column:
    """All of a page as an element."""
    return F.struct(F.lit(-1).alias("at"), F.size(tree["tags"]).alias("end")).cast(_SPAN)


def body(tree: Column) -> Column:
    found = F.get(T.of_name(tree, "body"), F.lit(0))
    return F.when(found.isNotNull(), _span(found)).otherwise(whole(tree))


def container(tree: Column, selectors: tuple[str, ...] = CONTAINERS) -> Column:
    """The first element that one of the selectors names, else the body."""
    attributes = {'[role="main"]': ("main", lambda t: attribute(t, "role") == "main"), ".content": ("content", lambda t: has_class(t, "content")), "#content": ("content", lambda t: attribute(t, "id") == "content")}

    def fits(e: Column) -> Column:
        tag = F.get(tree["tags"], e["at"])
        out = e["name"].isin(*(s for s in selectors if s not in attributes))
        for s in selectors:
            if s in attributes:
                word, holds = attributes[s]
                out = out | (F.contains(tag, F.lit(word)) & F.coalesce(holds(tag), F.lit(False)))
        return out

    return once(F.get(F.filter(tree["elements"], fits), F.lit(0)), lambda e: F.when(e.isNotNull(), _span(e)).otherwise(body(tree)))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def texts_of(tree: Column, *names: str, within: Column | None = None) -> Column:
    """Texts of the elements of these names, in order; of those inside one element, if it is given."""
    found = lambda t: T.of_name(t, *names) if within is None else T.inside(T.of_name(t, *names), within)
    return once(tree, lambda t: F.transform(found(t), lambda e: T.text_of(t, e)))


def paragraphs(tree: Column, within: Column | None = None) -> Column:
    """Texts of the p elements, in order, empty ones left out."""
    return F.filter(texts_of(tree, "p", within=within), lambda t: t != "")


def headings(tree: Column, levels: str = "123456") -> Column:
    """Array of struct(level, text) of the headings of these levels that have text."""
    each = lambda t: F.transform(T.of_name(t, *(f"h{k}" for k in levels)), lambda e: F.struct(F.substring(e["name"], 2, 1).cast("int").alias("level"), T.text_of(t, e).alias("text")))
    return F.filter(once(tree, each), lambda h: h["text"] != "")


def elements_with(tree: Column, word: str, fits) -> Column:
    """The elements whose start tag fits; one without attributes, or without the word, is passed over unread."""
    read = lambda tag: F.contains(tag, F.lit("=")) & F.contains(tag, F.lit(word)) & F.coalesce(fits(tag), F.lit(False))
    return once(tree, lambda t: F.filter(t["elements"], lambda e: once(F.get(t["tags"], e["at"]), read)))


def count_tags(part: Column, names: str) -> Column:
    return F.regexp_count(part, F.lit(rf"(?i)<(?:{names})[\s/>]"))


def tags(tree: Column, name: str) -> Column:
    """The start tags of an element."""
    return F.filter(tree["tags"], lambda t: t.rlike(rf"^(?i)<{name}[\s/>]"))


def attribute(tag: Column, name: str, decode=plainly_decoded) -> Column:
    """An attribute of a start tag; null if it is not there."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.when(tag.rlike(pattern), decode(F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))))


def has_class(tag: Column, name: str) -> Column:
    return F.array_contains(F.split(attribute(tag, "class"), r"\s+"), F.lit(name))


def meta(tree: Column, key: str, name: str) -> Column:
    """Trimmed content of the first meta element whose ``key`` attribute is ``name``."""
    found = F.filter(tags(tree, "meta"), lambda t: F.lower(attribute(t, key)) == name)
    return once(F.get(found, F.lit(0)), lambda t: F.trim(attribute(t, "content", decoded)))


def json_ld(tree: Column) -> Column:
    """Texts of the JSON-LD blocks."""
    scripts = F.filter(tree["tags"], lambda t: t.rlike(r"""(?is)^<script[^>]*\stype\s*=\s*["']?application/ld\+json["'\s>]"""))
    return F.transform(scripts, lambda t: F.regexp_extract(t, rf"(?is)^<script{T._ATTRIBUTES}(.*?)(?:</script[^>]*>)?\z", 1))
