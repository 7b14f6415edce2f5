"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import BOTS, TIERS

#: Word edges over ASCII letters, digits and underscore; ``\\b`` would ask for Unicode ones.
EDGE_BEFORE, EDGE_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def js_round(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x.cast("double") + F.lit(0.5)).cast("long")


def tier_of(score: Column) -> Column:
    """The tier of a score, rounded and cut to 0..100; null for a null score."""
    bounded = F.least(F.lit(100), F.greatest(F.lit(0), js_round(score)))
    out = F.when(bounded >= TIERS[0][1], TIERS[0][0])
    for name, least in TIERS[1:]:
        out = out.when(bounded >= least, name)
    return F.when(score.isNotNull(), out)


def weighted(weights: dict[str, float], value) -> Column:
    """The sum of value(name) * weight in the stated order, rounded."""
    total = None
    for name, w in weights.items():
        term = value(name).cast("double") * F.lit(w)
        total = term if total is None else total + term
    return js_round(total)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, js_round(part / whole * 100)).otherwise(F.lit(0).cast("long"))


def norm_name(name: Column) -> Column:
    """Lower case, every run of anything but a-z and 0-9 one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def fuzzy_match(a: Column, b: Column) -> Column:
    a, b = norm_name(a), norm_name(b)
    return (a == b) | F.contains(a, b) | F.contains(b, a)


def bot_of(agent: Column) -> Column:
    """The first bot whose pattern the user agent matches; null if none does."""
    out = None
    for name, pattern in BOTS:
        out = F.when(agent.rlike(pattern), name) if out is None else out.when(agent.rlike(pattern), name)
    return out


def month_before(at: Column) -> Column:
    """One calendar month earlier; a day the month lacks runs over into the next one."""
    first = F.add_months(F.trunc(at.cast("date"), "month"), -1)
    day = F.date_add(first, F.dayofmonth(at) - 1)
    return day.cast("timestamp_ntz") + (at.cast("timestamp_ntz") - F.date_trunc("day", at).cast("timestamp_ntz"))


def is_recent(at: Column, as_of: Column, days: int) -> Column:
    """Whether ``at`` lies less than ``days`` before ``as_of``, and not after it."""
    micros = F.timestamp_diff("MICROSECOND", at, as_of)
    return F.coalesce((micros > 0) & (micros < days * 86_400_000_000), F.lit(False))
