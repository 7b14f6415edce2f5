"""Secret scan with a trigram index, in SQL expressions only.

Every rule is a regular expression. ``trigram_query`` derives from it the trigrams that any match must hold, as
alternatives of sets. ``postings`` is an inverted index: for each trigram that some rule asks for (A-Z folded; no other list would ever be read), lists of the
numbers of the rows that hold it. ``candidates`` intersects the lists of each alternative, and only the rows left are verified with the regular expression. A rule
without mandatory trigrams, or with a construct that the derivation doesn't know, scans every row.

The lists are kept by blocks of ``BLOCK_ROWS`` row numbers, so that a trigram that most rows hold is many lists of bounded length and no hot key, and an intersection is a fold over
few bounded arrays. Rows are numbered in a written table: the numbers stay the same when an executor is lost. What meets the texts again is one narrow
row for each candidate.

Nulls: a null text is empty and has no spans. Rows that repeat a doc_id, or have none, are scanned one by one.
Offsets are code points, end exclusive; matches of a kind are leftmost and do not overlap; work is in proportion to
the text and its hits. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import BROADCAST_ROWS, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts, and the least length of a match that is kept.
    group: int = 0
    least: int = 1


# The base rules of the contract.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
# Published token formats.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
)
RULES = BASE + MORE
#: More alternatives than this are not followed; the literal run ends there instead.
MAX_BRANCHES = 64


#: What the derivation knows of a pattern: groups with flags that don't change its grammar, repeats (lazy and possessive ones too), plain sets, escapes of
#: classes, signs and codes, edges, any sign, and ASCII literals. Whatever else is found makes the rule scan fully: lookarounds, named groups, references back, quoted
#: parts, sets in sets, other escapes and other flags.
_TOKEN = re.compile(
    r"""(?P<open>\((?:\?[ims]*:)?(?!\?))|(?P<close>\))|(?P<flags>\(\?[ims]+\))|(?P<bar>\|)|(?P<repeat>(?:[?*+]|\{\d+(?:,\d*)?\})[?+]?)|(?P<set>\[(?:\\[^pPQEcukNxX0-9]|\\x[0-9A-Fa-f]{2}|[^\[\]\\&])+\])"""
    r"""|\\x(?P<code>[0-9A-Fa-f]{2})|\\(?P<class>[dDwWsShHvVbBAzZG])|\\(?P<sign>[^A-Za-z0-9])|(?P<edge>[$^])|(?P<any>\.)|(?P<literal>[^\\\[\](){}?*+|])""",
    re.S,
)

Ways = list[tuple[tuple[str, ...], str]]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of mandatory trigrams (lower case); empty if some way to match holds none.

    A way through the pattern is its finished literal runs and the run that the next literal would lengthen. What is not a
    literal ends the run, so no trigram is asked for that a match could lack.
    """
    found = list(_TOKEN.finditer(pattern))
    if "".join(m[0] for m in found) != pattern:
        return []
    tokens = [(m.lastgroup, m[m.lastgroup]) for m in found if m.lastgroup != "flags"]
    at = 0

    def ended(ways: Ways) -> Ways:
        return [((*done, run), "") for done, run in ways]

    def one(kind: str, text: str, ways: Ways) -> Ways:
        members = text[1:-1]
        if kind == "code":
            kind, text = "literal", chr(int(text, 16))
        if kind in ("literal", "sign") and text.isascii():
            return [(done, run + text.lower()) for done, run in ways]
        if kind == "set" and members.isalnum() and members.isascii() and len(ways) * len(members) <= MAX_BRANCHES:
            return [(done, run + c.lower()) for c in members for done, run in ways]
        return ways if kind == "edge" else ended(ways)

    def sequence(ways: Ways) -> Ways:
        nonlocal at
        while at < len(tokens) and tokens[at][0] not in ("bar", "close"):
            (kind, text), began = tokens[at], at
            at += 1
            inner = group(ways) if kind == "open" else one(kind, text, ways)
            if at < len(tokens) and tokens[at][0] == "repeat":
                times = tokens[at][1][:-1] if len(tokens[at][1]) > 1 and tokens[at][1][-1] in "?+" else tokens[at][1]
                at += 1
                if times == "?" and len(inner) + len(ways) <= MAX_BRANCHES:
                    inner = ways + inner
                elif times[0] in "?*" or times.startswith(("{0,", "{0}")):
                    inner = ended(ways)
                elif times != "{1}":
                    inner = ended(inner)
            elif kind == "open" and len(inner) > MAX_BRANCHES:
                inner = ended(ways)
            assert at > began
            ways = inner
        return ways

    def group(ways: Ways) -> Ways:
        nonlocal at
        out = sequence(ways)
        while at < len(tokens) and tokens[at][0] == "bar":
            at += 1
            out = out + sequence(ways)
        at += 1
        return out

    out = [frozenset(run[i : i + 3] for run in (*done, last) for i in range(len(run) - 2)) for done, last in group([((), "")])]
    return list(dict.fromkeys(out)) if all(out) else []


def _bound(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Row numbers of a list of the index.
BLOCK_ROWS = 1 << 16
_NO_KINDS = "array<string>"


def _plan(rules: tuple[Rule, ...]) -> list[tuple[str, int, list[str]]]:
    """(kind, number, trigrams) of each alternative of a rule."""
    return [(r.kind, k, sorted(branch)) for r in rules for k, branch in enumerate(trigram_query(r.pattern))]


def postings(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``trigram, block, rows``: the inverted index of ``rows(row, text)`` by the rules' trigrams, its lists in blocks, sorted."""
    vocabulary = sorted({t for _, _, trigrams in _plan(rules) for t in trigrams})
    wanted = F.array(*map(F.lit, vocabulary)).cast("array<string>")
    held = _bound(F.lower("text"), lambda folded: F.filter(wanted, lambda t: F.contains(folded, t)))
    return rows.select("row", F.explode(held).alias("trigram")).groupBy("trigram", F.floor(F.col("row") / BLOCK_ROWS).alias("block")).agg(F.sort_array(F.collect_list("row")).alias("rows"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row, kinds``: rows for which the lists of some alternative of a rule have a common number, with those rules."""
    plan = _plan(rules)
    asked = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("branch"), F.array(*map(F.lit, trigrams)).alias("asked")) for kind, k, trigrams in plan)).cast("array<struct<kind:string,branch:int,asked:array<string>>>")
    lists = index.select("block", "trigram", "rows", F.explode(F.filter(asked, lambda q: F.array_contains(q["asked"], F.col("trigram")))).alias("q"))
    # an alternative lacks nothing in a block that has a list of each of its trigrams; the shortest list begins
    met = lists.groupBy("q.kind", "q.branch", "block").agg(F.array_sort(F.collect_list(F.struct(F.size("rows").alias("n"), "rows"))).alias("lists"), F.first(F.size("q.asked")).alias("n")).where(F.size("lists") == F.col("n"))
    common = F.aggregate(F.slice("lists", 2, 1 << 20), F.get("lists", F.lit(0))["rows"], lambda s, x: F.array_intersect(s, x["rows"]))
    return met.select("kind", F.explode(common).alias("row")).groupBy("row").agg(F.collect_set("kind").alias("kinds"))


_BLOCK = 128


def _starts(gaps: Column, hits: Column) -> Column:
    """Where each hit starts: the text before it is its gaps and hits. Summed by blocks, so that work stays near the number of hits."""
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda s, x: s + x)
    steps = F.zip_with(hits, gaps, lambda h, g: (F.length(g) + F.length(h)).cast("long"))
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _BLOCK).cast("int")), lambda b: F.slice(s, b * _BLOCK + 1, _BLOCK))
    before = lambda sums: F.aggregate(sums, F.array(zero), lambda s, x: F.array_append(s, F.element_at(s, -1) + x))
    within = lambda blocks, first: F.flatten(F.transform(blocks, lambda b, k: F.transform(b, lambda x, j: F.get(first, k) + total(F.slice(b, F.lit(1), j + 1)))))
    ends = _bound(steps, lambda s: _bound(cut(s), lambda blocks: _bound(before(F.transform(blocks, total)), lambda first: within(blocks, first))))
    return F.zip_with(ends, hits, lambda end, h: end - F.length(h))


def _spans(docs: DataFrame, rules: tuple[Rule, ...], out: str) -> DataFrame:
    """Adds ``out``: array of struct(start, ord, kind, end), in order; looks for an indexed rule where ``kinds`` names it."""
    empty = F.array().cast("array<string>")
    scanned = {r.kind for r in rules if not trigram_query(r.pattern)}
    hit = lambda r: f"{out} hit {r.kind}"

    def when_due(r: Rule, x: Column) -> Column:
        return x if r.kind in scanned else F.when(F.array_contains("kinds", r.kind), x).otherwise(empty)

    # a rule that only asks for a length is quicker with the length in its pattern; the dropped matches hide none,
    # for a run of a class is shorter from any later start
    pattern = {r: f"{r.pattern[:-1]}{{{r.least - (4 if r.kind == 'access' else 0)},}}" if r.kind in ("access", "hex") else r.pattern for r in rules}
    docs = docs.withColumns({hit(r): when_due(r, F.regexp_extract_all("text", F.lit(pattern[r]), F.lit(0))) for r in rules})

    def spans_of(k: int, r: Rule) -> Column:
        hits = F.col(f"`{hit(r)}`")
        value = F.regexp_extract_all("text", F.lit(pattern[r]), F.lit(r.group))
        gaps = F.slice(F.split("text", pattern[r], -1), F.lit(1), F.size(hits))
        spans = F.arrays_zip(_starts(gaps, hits).alias("start"), hits.alias("hit"), value.alias("value"))
        kept = F.filter(spans, lambda s: F.length(s["value"]) >= r.least)
        shaped = F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("ord"), F.lit(r.kind).alias("kind"), (s["start"] + F.length(s["hit"])).alias("end")))
        return F.when(F.size(hits) > 0, shaped).otherwise(F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint>>"))

    each = [spans_of(k, r) for k, r in enumerate(rules)]
    return docs.withColumn(out, F.sort_array(F.concat(*each))).drop(*(hit(r) for r in rules))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, text, spans`` for each row of ``docs(doc_id, text)``; spans are struct(start, ord, kind, end), by start, then rule."""
    rows = written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")), "secret-rows")
    found = written(candidates(postings(rows, rules), rules), "secret-candidates")
    due = rows.join(found if found.count() > BROADCAST_ROWS else F.broadcast(found), "row", "left").select("doc_id", "text", F.coalesce("kinds", F.array().cast(_NO_KINDS)).alias("kinds"))
    return _spans(due, rules, "spans").select("doc_id", "text", "spans")


def written_as(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
