"""Site roll-ups, crawl deltas and scan history.

Scans are rows (id, project_id, url, score, page_type, content_hash, created_at, one column per sub-score). "Latest" is by
created_at, then id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import ISSUES, TIERS
from ..functions.exprs import js_round, percent, tier_of


def latest_scans(scans: DataFrame, keys: tuple[str, ...] = ("project_id", "url"), columns: tuple[str, ...] | None = None) -> DataFrame:
    """The newest row of each key. ``max_by`` combines before the shuffle and sorts nothing; carry few columns."""
    columns = columns or tuple(c for c in scans.columns if c not in keys)
    newest = F.max_by(F.struct(*columns), F.struct("created_at", "id")).alias("newest")
    return scans.groupBy(*keys).agg(newest).select(*keys, "newest.*")


def _page_weight() -> Column:
    return F.when(F.col("page_type") == "homepage", 2).otherwise(1)


def site_scores(pages: DataFrame) -> DataFrame:
    """A1: weighted mean of page scores per project, the homepage counting twice, and its tier."""
    w = _page_weight()
    score = js_round(F.sum(F.col("score") * w) / F.sum(w))
    return pages.groupBy("project_id").agg(score.alias("site_score")).withColumn("site_tier", tier_of(F.col("site_score")))


def page_means(pages: DataFrame) -> DataFrame:
    """A2: plain mean of page scores and number of pages."""
    return pages.groupBy("project_id").agg(js_round(F.avg("score")).alias("avg_score"), F.count("*").alias("total_pages"))


def tier_counts(pages: DataFrame) -> DataFrame:
    """A3: pages in each tier band, by raw score."""
    above = 1_000
    counts = []
    for name, least in TIERS:
        counts.append(F.count_if((F.col("score") >= least) & (F.col("score") < above)).alias(name) if name != TIERS[-1][0] else F.count_if(F.col("score") < above).alias(name))
        above = least
    return pages.groupBy("project_id").agg(*counts)


def sub_score_means(pages: DataFrame, scores: str = "sub_scores") -> DataFrame:
    """A4: mean of each sub-score over all pages of a project, for every key that some page of it has; a page without one counts 0.

    ``scores`` is a map. Sums and page counts combine before their shuffles, whose rows are keys of a project and not its pages.
    """
    sums = pages.select("project_id", F.explode(scores).alias("sub_score", "value")).groupBy("project_id", "sub_score").agg(F.sum(F.coalesce("value", F.lit(0))).alias("total"))
    counts = pages.groupBy(F.col("project_id").alias("project")).agg(F.count("*").alias("n"))
    return sums.join(counts, F.col("project_id").eqNullSafe(F.col("project"))).select("project_id", "sub_score", js_round(F.col("total") / F.col("n")).alias("average"))


def issue_prevalence(pages: DataFrame) -> DataFrame:
    """A5: how many pages have each issue; issues of no page are left out. One pass counts all of them."""
    counts = [F.count_if(F.coalesce(F.col(c), F.lit(0)) < least).alias(f"issue{k}") for k, (c, least, _) in enumerate(ISSUES)]
    each = F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(text).alias("description"), F.col(f"issue{k}").alias("affected_pages")) for k, (_, _, text) in enumerate(ISSUES)))
    out = pages.groupBy("project_id").agg(F.count("*").alias("total_pages"), *counts).select("project_id", "total_pages", F.inline(each)).where("affected_pages > 0")
    order = Window.partitionBy("project_id").orderBy(F.desc("affected_pages"), "rule")
    return out.select("project_id", "description", "affected_pages", "total_pages", percent(F.col("affected_pages"), F.col("total_pages")).alias("percentage"), F.row_number().over(order).alias("position"))


def priority_fixes(fixes: DataFrame, site: str, order: tuple[str, ...], top: int = 20) -> DataFrame:
    """Fixes of a site grouped by factor and the first 50 characters; the first one's text (of equals in ``order`` the least); the ``top`` by total points."""
    grouped = fixes.groupBy(site, "factor_id", F.substring("description", 1, 50).alias("prefix")).agg(
        F.count("*").alias("affected_pages"), F.sum("points").alias("total_impact"), F.min(F.struct(*order, "description", "layer")).alias("first")
    )
    rank = F.row_number().over(Window.partitionBy(site).orderBy(F.desc("total_impact"), "first"))
    ranked = grouped.withColumn("position", rank).where(F.col("position") <= top)
    return ranked.select(site, "factor_id", "first.description", "first.layer", js_round(F.col("total_impact") / F.col("affected_pages")).alias("avg_points"), "affected_pages", "total_impact", "position")


def ordered_fixes(fixes: DataFrame, page: str, order: str) -> DataFrame:
    """Fixes of a page by points, then in their order, numbered anew."""
    return fixes.withColumn("priority", F.row_number().over(Window.partitionBy(page).orderBy(F.desc("points"), order, "description")))


def projected_scores(pages: DataFrame, fixes: DataFrame, page: str) -> DataFrame:
    """The score a page would have with all its fixes, at most 100."""
    points = fixes.groupBy(page).agg(F.sum("points").alias("points"))
    return pages.join(points, page, "left").withColumn("projected_score", F.least(F.lit(100), F.col("score") + F.coalesce("points", F.lit(0)))).drop("points")


def crawl_counters(jobs: DataFrame) -> DataFrame:
    """Completed, skipped and total pages of each crawl job and the credits it used."""
    done, skipped = F.sum("pages_completed"), F.sum("pages_skipped")
    return jobs.groupBy("id").agg(done.alias("completed"), skipped.alias("skipped"), (done + skipped).alias("total"), done.alias("credits_used"))


def with_previous(scans: DataFrame, *columns: str) -> DataFrame:
    """Each scan beside the given columns of the one before it of the same project and url, as ``prev_<column>``."""
    before = F.lag(F.struct(*columns)).over(Window.partitionBy("project_id", "url").orderBy("created_at", "id"))
    out = scans.withColumn("before", before)
    return out.withColumns({f"prev_{c}": F.col(f"before.{c}") for c in columns}).drop("before")


def crawl_delta(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Pages of a crawl against their previous latest score: new, improved or declined; equal ones are in no list."""
    before = previous.select("project_id", "url", F.col("score").alias("previous_score"))
    joined = current.select("project_id", "url", "score").join(before, ["project_id", "url"], "left")
    delta = F.col("score") - F.col("previous_score")
    change = F.when(F.col("previous_score").isNull(), "new").when(delta > 0, "improved").when(delta < 0, "declined")
    return joined.select("project_id", "url", "score", "previous_score", delta.alias("delta"), change.alias("change")).where("change is not null")


def unchanged_pages(current: DataFrame, stored: DataFrame) -> DataFrame:
    """The complement of J3: crawled pages whose content hash is the latest stored one of their url."""
    known = latest_scans(stored, columns=("content_hash",)).where("content_hash is not null")
    return current.join(known, ["project_id", "url", "content_hash"], "left_semi")


def changed_pages(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Crawled pages that are to be scored again; a null hash, new or stored, matches nothing."""
    known = latest_scans(stored, columns=("content_hash",)).where("content_hash is not null")
    return current.join(known, ["project_id", "url", "content_hash"], "left_anti")


def latest_per_project(projects: DataFrame, scans: DataFrame) -> DataFrame:
    """Projects with their newest scan's score, tier and time (null when none)."""
    newest = latest_scans(scans, ("project_id",), ("score", "created_at"))
    newest = newest.select(F.col("project_id").alias("id"), F.col("score").alias("last_score"), tier_of(F.col("score")).alias("last_tier"), F.col("created_at").alias("last_scan_at"))
    return projects.join(newest, "id", "left")


def history(scans: DataFrame, keys: tuple[str, ...] = ("project_id",), limit: int = 100) -> DataFrame:
    """The oldest ``limit`` rows of each key, numbered."""
    return scans.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("created_at", "id"))).where(F.col("position") <= limit)


def within_budget(pages: DataFrame, site: str, bins: list[Column], order: list[Column], budget: Column) -> DataFrame:
    """The first pages of a site in crawl order, as many as its budget, with their position.

    ``bins`` never fall along the order, and tell its rows apart coarsely. The sizes of a site's bins say how many pages are before each: bins behind the budget are dropped
    unsorted, and only the pages of one bin are sorted together, so a large site is spread over its bins.
    """
    names = [f"{site} bin {k}" for k in range(len(bins))]
    rows = pages.withColumns(dict(zip(names, bins, strict=True))).withColumn(f"{site} budget", budget)
    sizes = rows.groupBy(site, *names).agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(site).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = sizes.select(*(F.col(c).alias(f"{c} of size") for c in (site, *names)), before.alias(f"{site} before"))
    met = None
    for c in (site, *names):
        same = F.col(c).eqNullSafe(F.col(f"{c} of size"))
        met = same if met is None else met & same
    near = rows.join(held, met).where(F.col(f"{site} before") < F.col(f"{site} budget"))
    position = F.col(f"{site} before") + F.row_number().over(Window.partitionBy(site, *names).orderBy(*order))
    return near.withColumn("position", position.cast("int")).where(F.col("position") <= F.col(f"{site} budget")).select(*pages.columns, "position")


def newest_jobs(jobs: DataFrame, key: str, limit: int) -> DataFrame:
    """The newest ``limit`` crawl jobs of each key."""
    return jobs.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id")))).where(F.col("position") <= limit)
