"""The most frequent keys without a shuffle of all keys: a summary of bounded size, then an exact count of its candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a summary keeps; some 10,000 narrow rows are what is broadcast.
TRACKED = 10_000
#: A frequent-items summary of M counters, a power of two of which three quarters are filled, misses a count by at most this share of all rows over M.
_ERROR = 3.5


def error_of(rows: int, tracked: int = TRACKED) -> float:
    """By how much a summary of so many rows may miss a count."""
    counters = 1 << max(0, (-(-tracked * 4 // 3) - 1).bit_length())
    return _ERROR * rows / counters


def candidates(rows: DataFrame, key: str, top: int, tracked: int = TRACKED) -> DataFrame | None:
    """``rows`` of the candidates for the ``top`` most frequent keys, or None where the summary can't prove that it has them all.

    Summaries of partitions are merged; a key that a summary doesn't name occurs at most twice its error (a named count lies within the error, and what may be an error is not
    named). The candidates are counted exactly: they hold the top if they are all rows there are, or if the last of the top occurs more often than a key that isn't named can.
    A null key is no candidate and is left out.
    """
    rows = rows.where(F.col(key).isNotNull())
    n, named = rows.agg(F.count("*"), F.expr(f"approx_top_k(`{key}`, {tracked}, {tracked})")).first()
    if not n:
        return rows
    kept = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(x["item"],) for x in named or []], rows.select(key).schema)), key, "left_semi")
    count = kept.groupBy(key).agg(F.count("*").alias("n"))
    covered, sizes = count.agg(F.coalesce(F.sum("n"), F.lit(0)), F.slice(F.sort_array(F.collect_list("n"), False), 1, top)).first()
    proved = covered == n or (len(sizes) == top and sizes[-1] > 2 * error_of(n, tracked))
    return kept if proved else None
