"""Alerts on score changes, their texts, and fan-out to subscribers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import SUB_SCORES, TIER_ORDER
from ..functions.exprs import js_round, tier_of
from .sites import with_previous

ALERT = "struct<type:string,severity:string,factor:string,title:string,message:string,previous_value:int,current_value:int>"


@dataclass(frozen=True)
class AlertConfig:
    min_score_drop: int = 5
    min_score_improvement: int = 10
    sub_score_floor: int = 20
    alert_on_tier_change: bool = True
    #: Fixed: a drop of so much is critical for a page and worth a warning for a sub-score.
    large_drop: int = 15


def _alert(when: Column, kind: str, severity: Column | str, title: Column, message: Column, before: Column | None = None, now: Column | None = None, factor: str | None = None) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    null = F.lit(None)
    return F.when(when, F.struct(F.lit(kind), text(severity), F.lit(factor), title, message, null if before is None else before, null if now is None else now).cast(ALERT))


def alert_list(current: dict[str, Column], previous: dict[str, Column], url: Column, config: AlertConfig = AlertConfig()) -> Column:
    """All alerts of one pair of scans (maps of ``score`` and the sub-scores to columns), as an array; null sub-scores are passed over."""
    score, before = current["score"], previous["score"]
    delta = score - before
    tier, tier_before = tier_of(score), tier_of(before)
    rank = lambda t: F.array_position(F.array(*map(F.lit, TIER_ORDER)), t)
    up = rank(tier) > rank(tier_before)
    worth = lambda x: F.abs(x).cast("string")
    out = [
        _alert(delta <= -config.min_score_drop, "score_drop", F.when(delta <= -config.large_drop, "critical").otherwise("warning"), F.concat(F.lit("Score dropped "), worth(delta), F.lit(" points")), F.concat(url, F.lit(" score dropped from "), before, F.lit(" to "), score), before, score),
        _alert(delta >= config.min_score_improvement, "score_improvement", "info", F.concat(F.lit("Score improved "), delta, F.lit(" points")), F.concat(url, F.lit(" score improved from "), before, F.lit(" to "), score), before, score),
    ]
    if config.alert_on_tier_change:
        title = F.concat(F.lit("Tier "), F.when(up, "upgraded").otherwise("downgraded"), F.lit(": "), tier_before, F.lit(" → "), tier)
        out.append(_alert(tier != tier_before, "tier_change", F.when(up, "info").otherwise("critical"), title, F.concat(url, F.lit(" moved from "), tier_before, F.lit(" to "), tier)))
    for name in SUB_SCORES:
        if name not in current:
            continue
        now, was = current[name], previous[name]
        out.append(_alert(now - was <= -config.large_drop, "factor_regression", "warning", F.concat(F.lit(f"{name} score dropped "), worth(now - was), F.lit(" points")), F.concat(F.lit(f"{name} on "), url, F.lit(": "), was, F.lit(" → "), now), was, now, name))
        out.append(_alert((now < config.sub_score_floor) & (was >= config.sub_score_floor), "new_issue", "warning", F.lit(f"{name} dropped below threshold ({config.sub_score_floor})"), F.concat(F.lit(f"{name} on "), url, F.lit(" is now "), now, F.lit(" (was "), was, F.lit(")")), was, now, name))
    return F.filter(F.array(*out), lambda a: a.isNotNull())


def score_alerts(scans: DataFrame, config: AlertConfig = AlertConfig()) -> DataFrame:
    """Alerts of each scan against the one before it of its project and url; a first scan has none."""
    columns = ("score", *(c for c in SUB_SCORES if c in scans.columns))
    paired = with_previous(scans.select("id", "project_id", "url", "created_at", *columns), *columns).where("prev_score is not null")
    alerts = alert_list({c: F.col(c) for c in columns}, {c: F.col(f"prev_{c}") for c in columns}, F.col("url"), config)
    return paired.select("id", "project_id", "url", "created_at", F.inline(alerts))


def fan_out(events: DataFrame, webhooks: DataFrame) -> DataFrame:
    """Each event (organization_id, type, ...) once for each active webhook of its organization that subscribes to its type."""
    hooks = webhooks.where("active").select(F.col("id").alias("webhook_id"), "organization_id", F.col("url").alias("endpoint"), "events")
    payload = F.to_json(F.struct(*sorted(c for c in events.columns if c != "organization_id")))
    return events.withColumn("payload", payload).join(hooks, "organization_id").where(F.array_contains("events", F.col("type"))).select("webhook_id", "endpoint", "organization_id", "type", "payload")


def unread(alerts: DataFrame, org: Column, limit: int = 20) -> DataFrame:
    """the newest unread alerts of an organization, 100 at most."""
    return alerts.where((F.col("organization_id") == org) & F.col("read_at").isNull()).orderBy(F.desc("created_at"), "id").limit(min(limit, 100))


def matching(alerts: DataFrame, search: str | None = None, severity: str | None = None) -> DataFrame:
    """alerts whose title or message holds a text, in either case, of one severity."""
    out = alerts
    if search:
        wanted = F.lower(F.lit(search))
        out = out.where(F.contains(F.lower("title"), wanted) | F.contains(F.lower("message"), wanted))
    return out.where(F.col("severity") == severity) if severity else out


def _signed(delta: Column) -> Column:
    return F.concat(F.when(delta > 0, "+").otherwise(""), delta.cast("string"))


def scan_messages(scans: DataFrame) -> DataFrame:
    """A message for each finished scan, with the signed change where there was one before."""
    paired = with_previous(scans, "score")
    change = F.when(F.col("prev_score").isNotNull(), F.concat(F.lit(" ("), _signed(F.col("score") - F.col("prev_score")), F.lit(")"))).otherwise("")
    text = F.concat(F.lit("Scan complete: "), F.col("url"), F.lit(" scored "), F.col("score"), F.lit("/100"), change)
    return paired.select("id", "project_id", text.alias("text"), tier_of(F.col("score")).alias("tier"))


def weekly_digest(scans: DataFrame, projects: DataFrame) -> DataFrame:
    """The numbers of an organization's weekly digest: scans, mean score, and the change against its week before."""
    week = F.date_trunc("week", "created_at").cast("date")
    rows = scans.join(projects.select(F.col("id").alias("project_id"), "organization_id"), "project_id")
    weekly = rows.groupBy("organization_id", week.alias("week")).agg(F.count("*").alias("scans"), F.count_distinct("project_id").alias("projects"), js_round(F.avg("score")).alias("avg_score"))
    before = weekly.select("organization_id", F.date_add("week", 7).alias("week"), F.col("avg_score").alias("last_score"))
    out = weekly.join(before, ["organization_id", "week"], "left")
    return out.withColumn("change", _signed(F.col("avg_score") - F.col("last_score")))
