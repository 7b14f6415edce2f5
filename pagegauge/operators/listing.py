"""L1: pages of long listings, without sorting what stands before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(by: str, tie: str, descending: bool) -> list[Column]:
    return [F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last(), F.col(tie)]


def numbered_page(rows: DataFrame, by: str, bins: Column, page: int = 1, limit: int = 20, descending: bool = True, tie: str = "id") -> DataFrame:
    """Page ``page`` of ``rows`` by a column, nulls last, ties by ``tie``: the same rows as offset paging gives.

    ``bins`` never fall as the column rises and tell its values apart coarsely (a day, a score): the sizes of the bins, one narrow aggregate, say in which of them the page lies. Only
    these are read again, as one range, and only their rows are sorted.
    """
    page, limit = max(1, page), min(100, max(1, limit))
    first = (page - 1) * limit
    sizes = rows.groupBy(bins.alias("bin")).agg(F.count("*").alias("size"))
    in_order = Window.orderBy(F.col("bin").desc_nulls_last() if descending else F.col("bin").asc_nulls_last())
    before = F.coalesce(F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = sizes.withColumn("before", before).where((F.col("before") < first + limit) & (F.col("before") + F.col("size") > first))
    low, high, skipped, unset = held.agg(F.min("bin"), F.max("bin"), F.min("before"), F.count_if(F.col("bin").isNull())).first()
    if skipped is None:
        return rows.limit(0)
    near = bins.between(F.lit(low), F.lit(high)) if low is not None else F.lit(False)
    return rows.where(near | bins.isNull() if unset else near).orderBy(*_order(by, tie, descending)).offset(first - skipped).limit(limit)


def page_after(rows: DataFrame, by: str, last: tuple | None, limit: int = 20, descending: bool = True, tie: str = "id") -> DataFrame:
    """The ``limit`` rows behind the last one shown, ``last`` = (value, tie); the first ones if it is None. What was shown is filtered out, not sorted."""
    limit = min(100, max(1, limit))
    if last is not None:
        value, at = last
        same = F.col(by).eqNullSafe(F.lit(value)) & (F.col(tie) > F.lit(at))
        behind = F.lit(False) if value is None else ((F.col(by) < F.lit(value)) if descending else (F.col(by) > F.lit(value))) | F.col(by).isNull()
        rows = rows.where(same | F.coalesce(behind, F.lit(False)))
    return rows.orderBy(*_order(by, tie, descending)).limit(limit)
