"""Names and entities across the pages of a site.

Rows are (site, url, organization_names, author_names, top_entities); rows without a site are left out. A site may hold most of all pages: its names are
dealt to ranges and its entity sets to tiles, and pairs of ranges or tiles are worked on apart. Neither pairs of names nor pairs of sets leave a
task: only which names hold or are held, and one sum for each pair of tiles.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.exprs import js_round, norm_name

#: Names of a range: as many are in one automaton, or are read by it.
NAMES = 100_000
#: Entities of the sets in a tile, and rows of a product that are held at a time.
TILE, ROWS = 1 << 16, 1_024


def _ranges(names: DataFrame, size: int, out: str) -> DataFrame:
    """``site, norm`` with the number of the range that a name falls into, and of all ranges of its site."""
    names = names.select("site", "norm").distinct()
    count = names.groupBy("site").agg(F.ceil(F.count("*") / size).cast("int").alias(f"{out}_ranges"))
    return names.join(count, "site").withColumn(out, F.pmod(F.xxhash64("norm"), F.col(f"{out}_ranges")).cast("int"))


def _schema(pages: DataFrame, columns: str) -> StructType:
    return StructType([pages.schema["site"], *StructType.fromDDL(columns)])


def _found(equal: bool, kind: pa.Schema):
    """Of the names of two ranges: which texts hold a pattern, and which patterns are held; by an automaton of the patterns."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        asked, names = rows.column("asked").to_pylist(), rows.column("norm").to_pylist()
        texts, patterns = ([n for n, a in zip(names, asked, strict=True) if a == which] for which in (False, True))
        automaton, holds, held = ahocorasick.Automaton(), set(), set()
        for p in patterns:
            if p:
                automaton.add_word(p, p)
        automaton.make_automaton()
        # nothing is in everything
        if "" in patterns:
            some = [t for t in texts if equal or t]
            holds.update(some)
            held.update([""] if some else [])
        for t in texts:
            for _, p in automaton.iter(t) if len(automaton) else ():
                if equal or p != t:
                    holds.add(t)
                    held.add(p)
        out = [(n, True) for n in holds] + [(n, False) for n in held]
        return pa.table({"site": [key[0].as_py()] * len(out), "norm": [n for n, _ in out], "holds": [h for _, h in out]}, schema=kind)

    return run


def containment(texts: DataFrame, patterns: DataFrame, equal: bool, size: int = NAMES) -> DataFrame:
    """``site, norm, holds``: texts of ``texts(site, norm)`` that hold one of ``patterns(site, norm)``, and the patterns held (``holds`` is false).

    ``equal``: whether a name holds its equal. Each pair of a range of texts and one of patterns is a group of at most two ranges.
    """
    t, p = _ranges(texts, size, "text"), _ranges(patterns, size, "pattern")
    sizes = t.select("site", "text_ranges").distinct().join(p.select("site", "pattern_ranges").distinct(), "site")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    t = t.drop("text_ranges").join(sizes, "site").select("site", "norm", "text", every("pattern_ranges").alias("pattern"), F.lit(False).alias("asked"))
    p = p.drop("pattern_ranges").join(sizes, "site").select("site", "norm", every("text_ranges").alias("text"), "pattern", F.lit(True).alias("asked"))
    schema = _schema(texts, "norm string, holds boolean")
    return t.unionByName(p).groupBy("site", "text", "pattern").applyInArrow(_found(equal, to_arrow_schema(schema)), schema).distinct()


def name_variants(pages: DataFrame, names: str) -> DataFrame:
    """``site, name``: spellings of one normal form, and names one of which holds another.

    Only distinct names of a site are compared; an empty normal form is contained in every other.
    """
    distinct = pages.select("site", F.explode(names).alias("name")).distinct().withColumn("norm", norm_name(F.col("name")))
    spelled = distinct.groupBy("site", "norm").agg(F.count("*").alias("n")).where("n > 1").join(distinct, ["site", "norm"]).select("site", "name")
    # one name of each form stands for it in the comparison
    forms = distinct.groupBy("site", "norm").agg(F.min("name").alias("name"))
    both = containment(forms, forms, equal=False).select("site", "norm").distinct()
    return spelled.union(forms.join(both, ["site", "norm"]).select("site", "name")).distinct()


def affected_pages(pages: DataFrame, variants: DataFrame, names: str) -> DataFrame:
    """Urls of a site with a name that equals, holds or is held by a variant."""
    used = pages.select("site", "url", F.explode(names).alias("used")).withColumn("norm", norm_name(F.col("used")))
    of = variants.select("site", norm_name(F.col("name")).alias("norm"))
    found = containment(used, of, equal=True).where("holds").union(containment(of, used, equal=True).where("NOT holds")).select("site", "norm").distinct()
    return used.join(found, ["site", "norm"]).select("site", "url").distinct()


def _block_sum(a: dict, b: dict, same: bool) -> float:
    """The sum of count * count * Jaccard over the pairs of a set of ``a`` and one of ``b`` that share something; each pair once if they are the same tile.

    Shared entities are counted in a product of rows by sets: those that many have by a matrix product, the others one incidence at a time.
    """
    n_a, n_b = len(a["n"]), len(b["n"])
    ids = np.intersect1d(a["ids"], b["ids"])
    col_a, col_b = np.searchsorted(ids, a["ids"]), np.searchsorted(ids, b["ids"])
    in_a, in_b = (np.minimum(c, max(len(ids) - 1, 0)) for c in (col_a, col_b))
    keep_a, keep_b = (ids[c] == x["ids"] if len(ids) else np.zeros(len(c), bool) for c, x in ((in_a, a), (in_b, b)))
    row_a, col_a, row_b, col_b = a["row"][keep_a], in_a[keep_a], b["row"][keep_b], in_b[keep_b]
    often = np.bincount(col_a, minlength=len(ids)).astype(float) * np.bincount(col_b, minlength=len(ids)) * 16 > n_a * n_b
    number = np.cumsum(often) - 1
    dense_b = np.zeros((n_b, int(often.sum())), np.float32)
    pick = often[col_b]
    dense_b[row_b[pick], number[col_b[pick]]] = 1
    rare = ~pick
    order = np.argsort(col_b[rare], kind="stable")
    by_col, first = row_b[rare][order], np.searchsorted(col_b[rare][order], np.arange(len(ids) + 1))
    total = 0.0
    for r in range(0, n_a, ROWS):
        here = (row_a >= r) & (row_a < r + ROWS)
        rows, cols, n = row_a[here] - r, col_a[here], min(ROWS, n_a - r)
        pick = often[cols]
        dense_a = np.zeros((n, dense_b.shape[1]), np.float32)
        dense_a[rows[pick], number[cols[pick]]] = 1
        both = (dense_a @ dense_b.T).astype(np.float64)
        rows, cols = rows[~pick], cols[~pick]
        # incidences in runs of bounded size
        times = first[cols + 1] - first[cols]
        upto = np.concatenate([[0], np.cumsum(times)])
        i = 0
        while i < len(cols):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + (1 << 22), "right")) - 1)
            t = times[i:j]
            place = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t) + np.repeat(first[cols[i:j]], t)
            both += np.bincount(np.repeat(rows[i:j], t) * n_b + by_col[place], minlength=n * n_b).reshape(n, n_b)
            i = j
        if same:
            both *= np.arange(n_b)[None, :] > np.arange(r, r + n)[:, None]
        union = a["n"][r : r + n, None] + b["n"][None, :] - both
        total += float((a["c"][r : r + n, None] * b["c"][None, :] * both / union).sum())
    return total


def _tile(rows: pa.Table) -> dict:
    items = rows.column("items").combine_chunks()
    sizes = np.diff(items.offsets.to_numpy()) if len(items) else np.zeros(0, np.int64)
    return {"n": sizes.astype(float), "c": rows.column("c").to_numpy().astype(float), "row": np.repeat(np.arange(len(sizes)), sizes), "ids": items.flatten().to_numpy()}


def _tile_sum(kind: pa.Schema):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        site, one, other = (k.as_py() for k in key)
        a, b = (_tile(rows.filter(pc.equal(rows.column("tile"), t))) for t in (one, other))
        return pa.table({"site": [site], "total": [_block_sum(a, b, one == other)]}, schema=kind)

    return run


def entity_overlap(pages: DataFrame, entities: str = "top_entities", tile: int = TILE) -> DataFrame:
    """Mean Jaccard overlap of all pairs of a site's pages, in percent; pairs of two empty sets do not count; 50 without pairs.

    Pages of equal sets are one class with a count. The classes of a site are dealt to tiles of some ``tile`` entities, every two tiles meet in one group, and the
    group gives one sum: what is shuffled is each class once for each tile of its site, whatever it shares with others. Entities are told apart by 64-bit hashes.
    """
    sets = pages.where(F.col("site").isNotNull()).select("site", F.array_sort(F.array_distinct(F.transform(F.coalesce(F.transform(entities, norm_name), F.array().cast("array<string>")), lambda e: F.xxhash64(e)))).alias("items"))
    classes = sets.groupBy("site", "items").agg(F.count("*").alias("c")).withColumn("n", F.size("items"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    alike = F.when(F.col("n") > 0, pairs("c")).otherwise(0.0)
    sizes = F.greatest(F.lit(1), F.ceil(F.sum("n") / tile)).cast("int").alias("tiles")
    per_site = classes.groupBy("site").agg(F.sum("c").alias("pages"), F.sum(F.when(F.col("n") == 0, F.col("c")).otherwise(0)).alias("empty"), F.sum(alike).alias("alike"), sizes)
    filled = classes.where("n > 0").join(per_site.select("site", "tiles"), "site").withColumn("tile", F.pmod(F.xxhash64("items"), F.col("tiles")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    met = filled.select("site", "items", "c", "tile", meets.alias("other")).withColumns({"one": F.least("tile", "other"), "two": F.greatest("tile", "other")})
    schema = _schema(pages, "total double")
    sums = met.groupBy("site", "one", "two").applyInArrow(_tile_sum(to_arrow_schema(schema)), schema).groupBy("site").agg(F.sum("total").alias("total"))
    out = per_site.join(sums, "site", "left").withColumn("n_pairs", pairs("pages") - pairs("empty"))
    overlap = F.when(F.col("n_pairs") > 0, js_round((F.coalesce("total", F.lit(0.0)) + F.col("alike")) / F.col("n_pairs") * 100)).otherwise(F.lit(50).cast("long"))
    return out.select("site", "pages", overlap.alias("overlap"))


def consistency(n: Column, penalty: int) -> Column:
    return F.when(n <= 1, 100).otherwise(F.greatest(F.lit(0), 100 - n * penalty)).cast("long")


def site_consistency(pages: DataFrame) -> DataFrame:
    """Organization and author names and entity overlap of a site; a site of one page is consistent."""
    count = lambda names, out: name_variants(pages, names).groupBy("site").agg(F.count("*").alias(out))
    rows = entity_overlap(pages).join(count("organization_names", "n_org"), "site", "left").join(count("author_names", "n_author"), "site", "left").na.fill(0, ["n_org", "n_author"])
    single = F.col("pages") <= 1
    one = lambda c: F.when(single, F.lit(100).cast("long")).otherwise(c)
    rows = rows.withColumns({"organization_consistency": one(consistency(F.col("n_org"), 20)), "author_consistency": one(consistency(F.col("n_author"), 15)), "entity_overlap": one(F.col("overlap"))})
    score = js_round(F.col("organization_consistency") * F.lit(0.35) + F.col("author_consistency") * F.lit(0.30) + F.col("entity_overlap") * F.lit(0.35))
    return rows.select("site", "pages", "organization_consistency", "author_consistency", "entity_overlap", score.alias("score"))
