"""Page scores from sub-scores and facts: score, layers, fixes, platforms, access and authority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (
    AUTHORITY_WEIGHTS,
    CITATION_REASONS,
    CITATION_WEIGHTS,
    FIXES,
    LAYER_WEIGHTS,
    PLATFORMS,
    PROBE_PENALTIES,
    STRENGTHS,
    SUB_SCORE_WEIGHTS,
    WAF_PENALTY,
    WEAKNESSES,
)
from ..functions.tree import once
from ..functions.exprs import js_round, tier_of, weighted


def page_score(value=F.col) -> Column:
    """The weighted sum of the 13 sub-scores."""
    return weighted(SUB_SCORE_WEIGHTS, value)


def layer_scores(value=F.col) -> Column:
    """Struct of the access, understanding and extractability scores."""
    return F.struct(*(weighted(weights, value).alias(layer) for layer, weights in LAYER_WEIGHTS.items()))


def with_scores(pages: DataFrame) -> DataFrame:
    return pages.withColumn("page_score", page_score()).withColumn("page_tier", tier_of(F.col("page_score"))).withColumn("layers", layer_scores())


def fix_list() -> Column:
    """The recommendations whose sub-score gate and condition hold, by points and then rule order, numbered from 1.

    Conditions name fact columns; an absent (null) fact counts as missing.
    """
    rules = []
    for k, (sub, gate, condition, points, layer, factor, text) in enumerate(FIXES):
        holds = (F.col(sub) < gate) & F.coalesce(F.expr(condition), F.lit(True))
        rules.append(F.when(holds, F.struct(F.lit(-points).alias("by"), F.lit(k).alias("rule"), F.lit(text).alias("description"), F.lit(points).alias("points"), F.lit(layer).alias("layer"), F.lit(factor).alias("factor_id"))))
    kept = F.array_sort(F.filter(F.array(*rules), lambda f: f.isNotNull()))
    return F.transform(kept, lambda f, i: F.struct(f["description"].alias("description"), f["points"].alias("points"), f["layer"].alias("layer"), f["factor_id"].alias("factor_id"), (i + 1).alias("priority")))


def citation_simulation() -> Column:
    """Struct of the overall mean, the six platforms (score, confidence, reasoning), strengths and weaknesses."""
    platforms, total = [], None
    for name, weights in CITATION_WEIGHTS.items():
        score = weighted(weights, F.col)
        good, fair, poor = CITATION_REASONS[name]
        band = lambda a, b, c, s=score: F.when(s >= 70, a).when(s >= 40, b).otherwise(c)
        platforms.append(F.struct(F.lit(name).alias("name"), score.alias("score"), band("high", "medium", "low").alias("confidence"), band(good, fair, poor).alias("reasoning")))
        total = score if total is None else total + score
    texts = lambda rules: F.filter(F.array(*(F.when(F.expr(c), F.lit(t)) for c, t in rules)), lambda t: t.isNotNull())
    return F.struct(js_round(total / len(platforms)).alias("overall"), F.array(*platforms).alias("platforms"), texts(STRENGTHS).alias("strengths"), texts(WEAKNESSES).alias("weaknesses"))


def platform_readiness(advise: bool = True) -> Column:
    """Array of the six platforms: score (sum of the weights of present signals), confidence, the top three recommendations.

    Needs the sub-scores, ``authority`` (null counts 0) and ``is_fresh`` (1 or 0). Recommendations that nobody reads cost most of the work: ``advise`` leaves them out.
    """
    out = []
    for key, name, signals in PLATFORMS:
        score, advice = F.lit(0.0), []
        for k, (signal, column, least, weight, text) in enumerate(signals):
            present = F.coalesce(F.col(column), F.lit(0)) >= least
            score = score + F.when(present, F.lit(weight * 100)).otherwise(0.0)
            gain = int(weight * 100 + 0.5)
            sentence = f"Improve {signal.lower()} for +{gain} points on {name}: {text}"
            advice.append(F.when(~present, F.struct(F.lit(-weight).alias("by"), F.lit(k).alias("ord"), F.lit(sentence).alias("text"))))
        score = js_round(score)
        confidence = F.when(score > 60, "high").when(score > 30, "medium").otherwise("low")
        fields = [F.lit(key).alias("platform"), F.lit(name).alias("name"), score.alias("score"), confidence.alias("confidence")]
        if advise:
            missing = F.slice(F.array_sort(F.filter(F.array(*advice), lambda a: a.isNotNull())), 1, 3)
            fields.append(F.transform(missing, lambda a: a["text"]).alias("recommendations"))
        out.append(F.struct(*fields))
    return F.array(*out)


def extremes(platforms: Column) -> Column:
    """Struct of the mean readiness and the strongest and weakest platform; of equals the first is stronger."""

    def of(ps: Column) -> Column:
        ranked = F.array_sort(F.transform(ps, lambda p, i: F.struct((-p["score"]).alias("by"), i.alias("ord"), p["platform"].alias("platform"))))
        mean = js_round(F.aggregate(ps, F.lit(0).cast("long"), lambda s, p: s + p["score"]) / F.size(ps))
        return once(ranked, lambda r: F.struct(mean.alias("overall"), F.element_at(r, 1)["platform"].alias("strongest"), F.element_at(r, -1)["platform"].alias("weakest")))

    return once(platforms, of)


def bot_access(probes: DataFrame) -> DataFrame:
    """The access score of a url from the status each agent got (0: no response)."""
    wide = probes.groupBy("url").agg(*(F.max(F.when(F.col("agent") == a, F.col("status"))).alias(a) for a in PROBE_PENALTIES))
    fine = F.coalesce(F.col("browser").between(200, 399), F.lit(False))
    bots = [a for a in PROBE_PENALTIES if a != "browser"]
    # an agent that was not probed is not blocked; one that got no response is
    blocked = {a: F.coalesce(F.col(a).isin(0, 403, 406, 429, 451) | (fine & (F.col(a) >= 400)), F.lit(False)) for a in bots}
    waf = F.coalesce(F.greatest(*(F.col(a).isin(403, 406) for a in bots)), F.lit(False))
    penalty = F.when(fine, 0).otherwise(PROBE_PENALTIES["browser"]) + F.when(waf, WAF_PENALTY).otherwise(0)
    for a in bots:
        penalty = penalty + F.when(blocked[a], PROBE_PENALTIES[a]).otherwise(0)
    names = F.filter(F.array(*(F.when(blocked[a], F.lit(a)) for a in bots)), lambda a: a.isNotNull())
    return wide.select("url", F.greatest(F.lit(0), F.lit(100) - penalty).cast("long").alias("score"), waf.alias("waf"), F.array_join(names, ",").alias("blocked"))


def domain_authority(signals: DataFrame) -> DataFrame:
    """Mean of the signals found for a domain, their weights made to sum to 1; 0 without any."""
    weight = F.create_map(*(F.lit(x) for k, w in AUTHORITY_WEIGHTS.items() for x in (k, w)))[F.col("signal")]
    w = F.when(F.col("found"), weight)
    sums = signals.groupBy("domain").agg(F.sum(F.col("score") * w).alias("total"), F.sum(w).alias("weight"), F.count_if("found").alias("n_signals"))
    return sums.select("domain", F.coalesce(js_round(F.col("total") / F.col("weight")), F.lit(0).cast("long")).alias("authority"), "n_signals")


def _points(*rules: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for holds, points in rules:
        total = total + F.when(holds, points).otherwise(0)
    return F.least(F.lit(100), total)


def backlink_score(domains: Column, links: Column, rank: Column) -> Column:
    """From referring domains, all backlinks and the rank (0 to 1000)."""
    steps = [(domains, (10, 50, 200, 1000)), (links, (100, 1_000, 10_000)), (rank, (100, 300, 500))]
    return _points(*((F.coalesce(x, F.lit(0)) >= least, 10) for x, bounds in steps for least in bounds))


def wikidata_score(found: Column, sitelinks: Column, has_description: Column, has_entity: Column) -> Column:
    """From an entry of the knowledge base and how many sites link to it."""
    links = F.coalesce(sitelinks, F.lit(0))
    return F.when(found, _points((F.lit(True), 30), (links > 0, 15), (links > 5, 15), (links > 20, 15), (has_description, 10), (has_entity, 15))).otherwise(0)


def knowledge_graph_score(result_score: Column, has_description: Column, url_matches: Column) -> Column:
    """From the best result of an entity search; a weak result or none gives 15."""
    found = _points((F.lit(True), 30), (result_score > 100, 20), (result_score > 500, 15), (has_description, 15), (url_matches, 20))
    return F.when(result_score >= 10, found).otherwise(15)
