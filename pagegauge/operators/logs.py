"""Analytics of web server access logs: visits of AI crawlers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bot_of
from ..functions.tree import once
from . import heavy

# The combined format (referrer optional), and a second, stricter form.
COMBINED = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\w+) (\S+)[^"]*" (\d{3}) \S+(?:\s+"[^"]*")?\s+"([^"]*)"'
SECOND = r'^(\S+) - \S+ \[([^\]]+)\] "(\w+) (\S+)[^"]*" (\d{3}) \d+\s+"[^"]*"\s+"([^"]*)"'
TIME = "dd/MMM/yyyy:HH:mm:ss Z"


def parsed_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Ip, time text, method, url, status and agent of each line that has one of the two formats.

    A line is matched once: its parts come out as one text, which is then split. Lines go as an empty list explodes, since a condition on the parts would be moved
    down to the source and have the pattern run again.
    """
    line = F.col(value)
    parts = "\u0001".join(f"${k + 1}" for k in range(6))
    cut = lambda p: F.regexp_replace(line, p + "[\\s\\S]*$", parts)
    # a line that is not cut stays as it is; one that is has no blank behind its first part
    made = once(cut(COMBINED), lambda c: F.when(c != line, c).otherwise(F.nullif(cut(SECOND), line)))
    fields = F.filter(F.array(F.split(made, "\u0001")), lambda f: f.isNotNull())
    fit = lines.where(F.length(line) > 0).select("*", F.explode(fields).alias("fields"))
    names = ("ip", "time", "method", "url", "status", "agent")
    out = fit.select(*(c for c in lines.columns if c != value), *(F.get("fields", F.lit(k)).alias(n) for k, n in enumerate(names)))
    return out.withColumn("status", F.col("status").cast("int"))


def log_time(text: Column, as_of: Column) -> Column:
    """The UTC instant of a log time; ``as_of`` where it cannot be read."""
    return F.coalesce(F.try_to_timestamp(text, F.lit(TIME)), as_of.cast("timestamp"))


def visits(lines: DataFrame, as_of: Column, value: str = "value") -> DataFrame:
    """Lines of known crawlers (others go before anything is shuffled) with ``bot`` and ``ts``."""
    # bound to a variable, the agent is taken from the line once and not for each pattern
    bot = F.filter(F.transform(F.array("agent"), bot_of), lambda b: b.isNotNull())
    found = parsed_lines(lines, value).select("*", F.explode(bot).alias("bot"))
    return found.withColumn("ts", log_time(F.col("time"), as_of))


def visit_counts(visits_: DataFrame) -> DataFrame:
    """Visits by (day, bot, url): all reports come from this one aggregate."""
    return visits_.groupBy(F.to_date("ts").alias("day"), "bot", "url").agg(F.count("*").alias("visits"), F.max("ts").alias("last_seen"))


def bot_breakdown(counts: DataFrame) -> DataFrame:
    """Visits, distinct pages and last visit of each bot."""
    per_page = counts.groupBy("bot", "url").agg(F.sum("visits").alias("visits"), F.max("last_seen").alias("last_seen"))
    return per_page.groupBy("bot").agg(F.sum("visits").alias("visits"), F.count("*").alias("unique_pages"), F.max("last_seen").alias("last_seen"))


def top_pages(counts: DataFrame, top: int = 20) -> DataFrame:
    """The most visited pages and the bots that came."""
    pages = counts.groupBy("url").agg(F.sum("visits").alias("visits"), F.array_join(F.sort_array(F.collect_set("bot")), ",").alias("bots"))
    return pages.orderBy(F.desc("visits"), "url").limit(top)


def frequent_visits(visits_: DataFrame, top: int = 20, tracked: int = heavy.TRACKED) -> DataFrame:
    """The visits of the urls that can be among the first of A8, where a summary of bounded size tells them, else all visits."""
    near = heavy.candidates(visits_, "url", top, tracked)
    return visits_ if near is None else near


#: Entries of a day's summary of pages: distinct counts up to this many are exact, and beyond it off by 1.6 % (one standard deviation).
DAY_ENTRIES = 12


def day_states(visits_: DataFrame, log2: int = DAY_ENTRIES) -> DataFrame:
    """What is stored of a day and bot: visits, the last one, and a mergeable summary of the pages (a theta sketch of 2^``log2`` entries)."""
    return visits_.groupBy(F.to_date("ts").alias("day"), "bot").agg(F.count("*").alias("visits"), F.max("ts").alias("last_seen"), F.theta_sketch_agg("url", log2).alias("pages"))


def merged_breakdown(states: DataFrame, log2: int = DAY_ENTRIES) -> DataFrame:
    """A7 for any period, from the states of its days; no line is read again."""
    return states.groupBy("bot").agg(F.sum("visits").alias("visits"), F.theta_sketch_estimate(F.theta_union_agg("pages", log2)).alias("unique_pages"), F.max("last_seen").alias("last_seen"))


def merged_totals(states: DataFrame, log2: int = DAY_ENTRIES) -> DataFrame:
    """A10 for any period, from the states of its days."""
    return states.agg(F.coalesce(F.sum("visits"), F.lit(0)).alias("total_visits"), F.coalesce(F.theta_sketch_estimate(F.theta_union_agg("pages", log2)), F.lit(0)).alias("unique_pages"))


def daily_trend(counts: DataFrame) -> DataFrame:
    """Visits of each UTC day that has some."""
    return counts.groupBy("day").agg(F.sum("visits").alias("visits"))


def totals(counts: DataFrame) -> DataFrame:
    """A10: all visits and distinct pages."""
    pages = counts.groupBy("url").agg(F.sum("visits").alias("visits"))
    return pages.agg(F.coalesce(F.sum("visits"), F.lit(0)).alias("total_visits"), F.count("*").alias("unique_pages"))


def new_bots(counts: DataFrame, known: DataFrame) -> DataFrame:
    """Bots that came and are not known yet."""
    return counts.select("bot").distinct().join(known, "bot", "left_anti")
