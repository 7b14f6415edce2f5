"""Mixing sources to target weights by hierarchical budgets, in SQL expressions only.

The documents make a tree: domain, then language, then source. A token budget enters at the root and flows down: a node
shares it among its children by weight, but no child gets more than its leaves can give (their tokens times the
most epochs). What a child cannot take goes to its siblings first, since the parent's share was already cut to what
the parent's subtree can give; only what a whole subtree cannot take reaches the siblings of its parent.

A leaf takes a prefix of its token stream: whole epochs, then the start of one more, each epoch in an order of its own drawn
from the seed; the last document is cut. Documents are dealt into bins of that order, so that only the bin in which the
prefix ends is ever sorted, however large the leaf.

Nulls: a null text has no tokens and is never taken; null domain, lang or source count as empty. Weights default to 1; a weight
of 0 takes nothing. Ties in the order go by doc_id; rows that repeat a doc_id with equal text stand side by side. Extra columns
pass through ``mixed``, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

WORD = r"[^\x20\x09-\x0D]+"
LEAF = ("domain", "lang", "source")
#: Documents that one bin should hold, and the most bins of a leaf.
BIN_ROWS, MAX_BINS = 5_000, 1 << 16
#: As many leaves are broadcast; more are joined by a shuffle on salted keys.
BROADCAST_LEAVES = 20_000
SALTS = 32


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*(F.lit(x) for k, w in weights.items() for x in (k, float(w))))
    return F.coalesce(F.get(F.array(table[F.col(level)]), F.lit(0)), F.lit(1.0))


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``budget`` to children (own key, weight, capacity, parent_budget): water is filled to one level per parent.

    In ascending order of capacity / weight, the children before the first that its level does not fill are full.
    """
    own = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = own.orderBy(F.col("capacity") / F.col("weight"), *LEAF[: len(parent) + 1])
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    lifted = nodes.where("weight > 0").withColumn("level", (F.col("parent_budget") - before) / rest)
    open_ = F.when(F.col("capacity") > F.col("weight") * F.col("level"), F.col("level"))
    lifted = lifted.withColumn("level", F.first(open_, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return lifted.withColumn("budget", F.least("capacity", F.coalesce(F.col("weight") * F.col("level"), F.col("capacity"))))


def leaf_budgets(leaves: DataFrame, tokens: Column, max_epochs: int, weights: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """``leaves(domain, lang, source, n, tokens)`` with ``quota``, the whole tokens each leaf is to give; ``tokens``: the root's budget."""
    weights = weights or {}
    able = leaves.withColumn("capacity", F.col("tokens").cast("double") * max_epochs)
    total = able.agg(F.coalesce(F.sum("capacity"), F.lit(0.0)).alias("all"), tokens.cast("double").alias("wanted"))
    flow = total.select(F.least("all", F.coalesce("wanted", F.lit(0.0))).alias("parent_budget"))
    parent: list[str] = []
    for level in LEAF:
        keys = [*parent, level]
        nodes = able.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(level, weights.get(level)))
        # the root is one row
        nodes = nodes.join(flow, parent) if parent else nodes.crossJoin(F.broadcast(flow))
        flow = _share(nodes, parent).select(*keys, F.col("budget").alias("parent_budget"))
        parent = keys
    return leaves.join(flow, list(LEAF)).withColumn("quota", F.floor("parent_budget").cast("long")).drop("parent_budget")


def _drawn(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _bin(draw: Column, bins: Column) -> Column:
    return F.floor(F.conv(F.substring(draw, 1, 8), 16, 10).cast("double") / float(1 << 32) * bins).cast("int")


def _with_leaf(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows beside the plan of their leaf. A leaf may hold a third of all rows: it is not shuffled, or it is salted."""
    if plan.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES:
        return rows.join(F.broadcast(plan), list(LEAF))
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*LEAF, "salt"]).drop("salt")


def _selected(rows: DataFrame, sizes: DataFrame, wanted: Column, max_epochs: int, seed: int, weights) -> DataFrame:
    """``rows`` (doc_id, LEAF, tokens, others) once for each epoch in which they are taken, with ``epoch`` and ``taken``.

    ``sizes`` has the rows' doc_id, LEAF and tokens only.
    """
    leaves = sizes.groupBy(*LEAF).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    plan = leaf_budgets(leaves, wanted, max_epochs, weights).where("tokens > 0").select(
        *LEAF, F.floor(F.col("quota") / F.col("tokens")).cast("int").alias("whole"), (F.col("quota") % F.col("tokens")).alias("rest"),
        F.least(F.ceil(F.col("n") / BIN_ROWS), F.lit(MAX_BINS)).cast("int").alias("bins"),
    )
    plan = written(plan, "mixing-plan")
    place = lambda df: df.withColumn("draw", _drawn(seed, F.col("whole"), F.col("doc_id"))).withColumn("bin", _bin(F.col("draw"), F.col("bins")))
    # which bin of each leaf the prefix ends in, and what comes before it
    per_bin = place(_with_leaf(sizes.where("tokens > 0"), plan)).groupBy(*LEAF, "bin", "rest").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("bin"))
    ends = per_bin.withColumn("upto", upto).where("upto >= rest").groupBy(*LEAF).agg(F.min(F.struct("bin", (F.col("upto") - F.col("tokens")).alias("before"))).alias("end"))
    plan = written(plan.join(ends, list(LEAF)).select(*LEAF, "whole", "rest", "bins", F.col("end.bin").alias("last"), F.col("end.before").alias("before")), "mixing-plan")
    placed = place(_with_leaf(rows.where("tokens > 0"), plan))
    epochs = F.sequence(F.lit(0), F.col("whole"))
    repeat = placed.where("bin < last or whole > 0").withColumn("epoch", F.explode(F.filter(epochs, lambda e: (e < F.col("whole")) | ((F.col("bin") < F.col("last")) & (F.col("rest") > 0)))))
    repeat = repeat.withColumn("taken", F.col("tokens"))
    start = F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    edge = placed.where("bin = last and rest > 0").withColumn("start", start).where("start < rest")
    edge = edge.withColumn("epoch", F.col("whole")).withColumn("taken", F.least("tokens", F.col("rest") - F.col("start"))).drop("start")
    return repeat.unionByName(edge).drop("whole", "rest", "bins", "last", "before", "draw", "bin")


def selection(docs: DataFrame, domain: Column, share: float = 0.5, max_epochs: int = 2, seed: int = 7, weights: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """``doc_id, domain, lang, source, epoch, tokens, taken``: what is taken of each document in each epoch.

    The budget is ``share`` of all tokens there are.
    """
    name = lambda c: F.coalesce(c, F.lit(""))
    sizes = docs.select("doc_id", name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"), n_tokens(F.col("text")).alias("tokens"))
    sizes = written(sizes, "mixing-sizes")
    return _selected(sizes, sizes, F.sum("tokens") * F.lit(float(share)), max_epochs, seed, weights)


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def mixed(docs: DataFrame, domain: Column, share: float = 0.5, max_epochs: int = 2, seed: int = 7, weights: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """The rows of ``docs`` as they are taken, once for each epoch, with ``epoch`` and ``taken`` (``epoch_``, ``taken_``, where ``docs`` has such columns); a cut text keeps its first words, joined by one space."""
    name = lambda c: F.coalesce(c, F.lit(""))
    keys = {"domain": name(domain), "lang": name(F.col("lang")), "source": name(F.col("source"))}
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id"), F.col("text"), *(x.alias(k) for k, x in keys.items()))
    rows = packed.select("row", "doc_id", *LEAF, n_tokens(F.col("text")).alias("tokens"))
    sizes = written(rows.select("doc_id", *LEAF, "tokens"), "mixing-sizes")
    taken = _selected(rows, sizes, F.sum("tokens") * F.lit(float(share)), max_epochs, seed, weights)
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("taken").cast("int")), " ")
    text = F.when(F.col("taken") < F.col("tokens"), cut).otherwise(F.col("row.text"))
    columns = [text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return taken.select(*columns, *(F.col(c).alias(_free(c, docs.columns)) for c in ("epoch", "taken")))
