"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors of a label are made one first, so that copies are counted and not compared. The distinct vectors of a
label are dealt into tiles of about ``TILE`` rows, and each pair of tiles is one group of one task. There the unit
vectors are quantised to int8 steps of their own scale, v = s q + r, and for two of them

    a.b = s_a s_b q_a.q_b + r_a.(s_b q_b) + a.r_b  <=  s_a s_b q_a.q_b + |r_a| |s_b q_b| + |r_b|

so only pairs whose bound reaches the threshold are computed again in double precision, on the given components.
A tile pair sends on a number of links for each vector and a star for each of its groups of linked vectors, never its pairs;
the stars are joined into components.

Vectors that are null, zero, of no label, or with a null or non-finite component link with nothing. Vectors of different
length never link. Rows that repeat a vec_id count as vectors of their own and share their component. Null ids take part under
no id and link with nothing. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import discard, join_by_weight, written

THRESHOLD = 0.93
#: Rows of a tile; each vector is sent to as many tasks as its label has tiles.
TILE = 4096
#: What rounding in double precision can add to the bound.
SLACK = 1e-9


def linkable(vector: Column, label: Column, vec_id: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec_id.isNotNull() & label.isNotNull() & vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _marks() -> dict[str, Column]:
    """A class by 128 bits of its label and vector; the sum with 0 makes -0.0 and 0.0 one."""
    vector = F.transform("embedding", lambda x: (x + F.lit(0)).cast("double"))
    return {"mark1": F.xxhash64("label", vector), "mark2": F.xxhash64(vector, "label", F.lit("second"))}


def _units(x: np.ndarray) -> np.ndarray:
    # scaled first, so that neither very large nor very small components leave the range of a double when squared
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 steps, their scale, the norm of what they stand for and the norm of the rest."""
    scale = np.abs(units).max(1) / 127
    steps = np.rint(units / scale[:, None]).astype(np.int8)
    stands_for = steps * scale[:, None]
    norm = lambda v: np.sqrt(np.einsum("ij,ij->i", v, v))
    return steps, scale, norm(stands_for), norm(units - stands_for)


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of rows of ``a`` and ``b`` with cosine >= threshold."""
    ua, ub = _units(a), _units(b)
    qa, sa, na, ra = _quantised(ua)
    qb, sb, nb, rb = _quantised(ub)
    # products of int8 steps are whole numbers that single precision holds exactly up to 2**24, about 1,000 dimensions
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    left, right = qa.astype(kind), qb.astype(kind).T
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(0, len(a), 256):
        s = slice(k, k + 256)
        bound = (left[s] @ right) * (sa[s, None] * sb[None, :]) + ra[s, None] * nb[None, :] + rb[None, :]
        i, j = np.nonzero(bound >= threshold - SLACK)
        i += k
        for m in range(0, len(i), 1 << 17):
            x, y = i[m : m + (1 << 17)], j[m : m + (1 << 17)]
            near = np.einsum("ij,ij->i", ua[x], ub[y]) >= threshold
            found.append((x[near], y[near]))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(y for _, y in found)])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes is joined to."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def tile_links(table: pa.Table, threshold: float = THRESHOLD) -> pa.Table:
    """Of the vectors of two tiles: (id, links, root), a row for each that has a link across these tiles."""
    ids, sizes, side = (table.column(c).to_numpy() for c in ("id", "size", "side"))
    column = table.column("vector").combine_chunks()
    vectors = np.asarray(column.flatten(), np.float64).reshape(len(ids), -1)
    by = np.lexsort((ids, side))
    ids, sizes, side, vectors = ids[by], sizes[by], side[by], vectors[by]
    here, there = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)  # side 0: a tile with itself
    links = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    if len(here) and len(there):
        i, j = linked_pairs(vectors[here], vectors[there], threshold)
        i, j = here[i], there[j]
        other = i != j
        i, j = i[other], j[other]
        np.add.at(links, i, sizes[j])
        if side[0] != 0:
            np.add.at(links, j, sizes[i])
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        root = np.argsort(ids, kind="stable")[_roots(len(ids), rank[i], rank[j])[rank]]
    keep = links > 0
    return pa.table({"id": ids[keep], "links": links[keep], "root": ids[root[keep]]})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors(vec_id, embedding, label)``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    fit = rows.where(linkable(F.col("embedding"), F.col("label"), F.col("vec_id")))
    # -0.0 and 0.0 are one value to groupBy, as they are to the cosine
    classes = fit.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"))
    classes = written(classes.withColumns(_marks()), "vector-classes")
    tiles = classes.groupBy("label", F.size("embedding").alias("dims")).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = classes.withColumn("dims", F.size("embedding")).join(tiles, ["label", "dims"])
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = placed.select(
        "label", "dims", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "size",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1).alias("side"), F.col("embedding").alias("vector"),
    )
    found = dealt.groupBy("label", "dims", "i", "j").applyInArrow(lambda t: tile_links(t, threshold), "id long, links long, root long")
    found = written(found, "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_class = classes.join(links, "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("long")
    per_class = written(per_class.select("mark1", "mark2", "size", n_links.alias("n_links"), F.coalesce("component", "id").alias("component_id")), "vector-components")
    discard(classes, found)
    # a vector that very many rows have is no hot key: its class is broadcast
    linked = join_by_weight(fit.withColumns(_marks()).select("vec_id", "mark1", "mark2"), per_class, ["mark1", "mark2"], "size")
    linked = linked.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rows.where(~F.coalesce(linkable(F.col("embedding"), F.col("label"), F.col("vec_id")), F.lit(False)))
    return linked.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
