"""JSON-LD as VARIANT: blocks are parsed once, and walked by column expressions.

A block that is no JSON, or nested more than a thousand deep, or that names a key twice in one object, is bad and counted. The walk goes level by level: it holds the values of
one depth and replaces them by what is in them, as often as the blocks have brackets. Objects keep no order of keys in a VARIANT, so types come
sorted.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import json_ld
from .tree import once

#: Deeper blocks aren't parsed.
_DEEPEST = 1_000
_OBJECT, _ARRAY = "map<string,variant>", "array<variant>"


def _object(v: Column) -> Column:
    """The values of an object by key; null for anything else."""
    return F.try_variant_get(v, "$", _OBJECT)


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", _ARRAY)


def _nested(v: Column) -> Column:
    """Whether a value is an object or an array; its schema, which would tell as well, is found by a recursion that deep values end."""
    return _object(v).isNotNull() | _array(v).isNotNull()


def _none() -> Column:
    return F.array().cast(_ARRAY)


def _text(v: Column) -> Column:
    """A string that isn't empty, or a number or truth value as text; null for objects, arrays and what is not there."""
    return once(v, lambda x: F.when(~_nested(x), F.nullif(F.try_variant_get(x, "$", "string"), F.lit(""))))


def _string(v: Column) -> Column:
    """A string as it is; null for other kinds."""
    return once(v, lambda x: F.when(~_nested(x) & (F.schema_of_variant(x) == "STRING"), F.try_variant_get(x, "$", "string")))


def _holds(v: Column) -> Column:
    """Whether a value counts as true: not null, empty, zero or false."""
    return once(v, lambda x: _nested(x) | F.coalesce(~F.try_variant_get(x, "$", "string").isin("", "0", "false"), F.lit(False)))


def _types(m: Column) -> Column:
    """``@type`` of an object: a string, or the strings of an array."""
    one = m["@type"]
    many = F.filter(F.transform(F.coalesce(_array(one), _none()), _string), lambda t: t.isNotNull())
    return F.coalesce(F.when(_string(one).isNotNull(), F.array(_string(one))), many)


def roots(blocks: Column) -> Column:
    """struct(values, n_bad): the values of the blocks, those of arrays one by one."""
    texts = F.filter(blocks, lambda b: F.trim(F.regexp_replace(b, r"\s+", " ")) != "")
    values = lambda parsed: F.flatten(F.transform(F.filter(parsed, lambda v: v.isNotNull()), lambda v: F.coalesce(_array(v), F.array(v))))
    return once(F.transform(texts, F.try_parse_json), lambda parsed: F.struct(values(parsed).alias("values"), F.size(F.filter(parsed, lambda v: v.isNull())).alias("n_bad")))


_STATE = "struct<level:array<struct<value:variant,counts:boolean>>,types:array<string>,speakable:boolean>"


def _walked(objects: Column, levels: Column) -> Column:
    """struct(types, speakable) of objects: types of ``@graph`` and of objects in values, other arrays entered only to look for ``speakable``."""
    node = lambda v, counts: F.struct(v.alias("value"), counts.alias("counts"))

    def inner(n: Column) -> Column:
        def of_object(m: Column) -> Column:
            graph = F.transform(F.coalesce(_array(m["@graph"]), _none()), lambda v: node(v, n["counts"]))
            others = F.filter(F.map_entries(m), lambda e: (e["key"] != "@graph") | _array(e["value"]).isNull())
            values = F.concat(graph, F.transform(others, lambda e: node(e["value"], n["counts"] & _array(e["value"]).isNull())))
            return F.filter(values, lambda x: _nested(x["value"]))

        items = lambda a: F.transform(a, lambda v: node(v, n["counts"] & _array(v).isNull()))
        return once(_object(n["value"]), lambda m: F.when(m.isNotNull(), of_object(m)).otherwise(items(F.coalesce(_array(n["value"]), _none()))))

    def step(s: Column, _: Column) -> Column:
        def found(ms: Column) -> Column:
            types = F.flatten(F.transform(F.filter(ms, lambda x: x["counts"]), lambda x: _types(x["m"])))
            return F.struct(F.flatten(F.transform(s["level"], inner)).alias("level"), F.array_distinct(F.concat(s["types"], types)).alias("types"), (s["speakable"] | F.exists(ms, lambda x: F.map_contains_key(x["m"], "speakable"))).alias("speakable"))

        maps = F.filter(F.transform(s["level"], lambda n: F.struct(_object(n["value"]).alias("m"), n["counts"].alias("counts"))), lambda x: x["m"].isNotNull())
        return F.when(F.size(s["level"]) > 0, once(maps, found)).otherwise(s)

    begun = F.struct(F.transform(objects, lambda v: node(v, F.lit(True))).alias("level"), F.array().cast("array<string>").alias("types"), F.lit(False).alias("speakable")).cast(_STATE)
    return F.aggregate(F.sequence(F.lit(1), levels), begun, step, lambda s: F.struct(F.sort_array(s["types"]).alias("types"), s["speakable"].alias("speakable")))


def _item(v: Column, top: bool) -> Column:
    """What the rules ask of an object: its own fields, its author's and its rating's."""

    def fields(m: Column) -> Column:
        author, rating = _object(m["author"]), _object(m["aggregateRating"])
        number = lambda x: F.try_variant_get(x, "$", "double")
        credits = lambda x: _holds(x["jobTitle"]) | _holds(x["knowsAbout"])
        return F.struct(
            F.coalesce(_string(m["@type"]), F.lit("")).alias("type"), F.lit(top).alias("top"), *(_text(m[key]).alias(name) for name, key in (("headline", "headline"), ("name", "name"), ("description", "description"), ("date_published", "datePublished"), ("date_modified", "dateModified"), ("date_created", "dateCreated"))),
            F.coalesce(_text(author["name"]), _text(m["author"])).alias("author"), _holds(m["author"]).alias("has_author"), _holds(m["offers"]).alias("has_offers"), (_holds(m["reviewRating"]) | _holds(m["ratingValue"])).alias("has_rating"),
            number(rating["ratingValue"]).alias("rating"), F.when(rating.isNotNull(), F.coalesce(number(rating["bestRating"]), F.lit(5.0))).alias("best"), _text(author["name"]).alias("author_name"),
            F.coalesce(_holds(author["description"]), F.lit(False)).alias("author_bio"), F.coalesce(credits(author), F.lit(False)).alias("author_credits"), _holds(m["description"]).alias("own_bio"), credits(m).alias("own_credits"),
            F.size(F.coalesce(_array(m["mainEntity"]), _none())).alias("n_main"),
        )

    return once(_object(v), fields)


@lru_cache(maxsize=8)
def facts_column(tree: str) -> Column:
    """``facts`` of the blocks in a column's tree; the expression is large and is put together once."""
    return facts(json_ld(F.col(tree)))


def facts(blocks: Column) -> Column:
    """struct(types, items, n_objects, n_bad, speakable) of a page's blocks; an item of ``@graph`` follows the object it is in."""

    def of_roots(r: Column) -> Column:
        objects = F.filter(r["values"], lambda v: _object(v).isNotNull())
        return once(objects, lambda o: of_objects(o, r["n_bad"]))

    def of_objects(objects: Column, n_bad: Column) -> Column:
        graph = lambda v: F.filter(F.coalesce(_array(_object(v)["@graph"]), _none()), lambda g: _object(g).isNotNull())
        items = F.flatten(F.transform(objects, lambda v: F.concat(F.array(_item(v, True)), F.transform(graph(v), lambda g: _item(g, False)))))
        brackets = F.aggregate(blocks, F.lit(0), lambda s, b: s + F.regexp_count(b, F.lit(r"[{\[]")))
        walked = _walked(objects, F.greatest(F.lit(1), F.least(brackets, F.lit(_DEEPEST))))
        return once(walked, lambda w: F.struct(w["types"].alias("types"), items.alias("items"), F.size(objects).alias("n_objects"), n_bad.alias("n_bad"), w["speakable"].alias("speakable")))

    return once(roots(F.coalesce(blocks, F.array().cast("array<string>"))), of_roots)
